"""Secret scan with corpus-wide ownership frequency.

Every text is searched for credentials in context (assignments), access key ids, long hex strings and other
long opaque strings. What a match would disclose is its value; of values only digests leave the scan. The
digests are counted over the whole corpus: by how many owners, and in how many of their repositories,
a value stands. A value that several owners hold is an example that was copied; one that a single owner
holds in few repositories and that looks random is live. Strings without context count only if they are live.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablemill.llm.common import read
from tablemill.llm.queries import query
from tablemill.session import stage

# Searched in the text with A-Z in lower case, which moves nothing.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
HEX = re.compile(rb"[0-9a-f]{16,}")
OPAQUE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
#: Kinds of spans, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "opaque")
#: An assignment's value has at least so many characters.
LEAST_VALUE = 12
#: Parts of values that stand for a value.
PLACEHOLDER = re.compile(rb"example|sample|dummy|changeme|placeholder|xxxx|your|\*\*\*|1234567|abcdef0|0123456")
#: A null doc_id's key.
NULL_KEY = -(1 << 63)
#: Values with more than this share of all occurrences are joined by a broadcast; there are at most so many.
COMMON = 100_000
#: A value with no more occurrences than this is never common.
LEAST_COMMON = 1_000


@dataclass(frozen=True)
class Limits:
    """What makes a value live: few holders, and characters that look drawn at random."""

    owners: int = 1
    repositories: int = 3
    bits_in_context: float = 2.5
    bits_alone: float = 3.5
    digits_alone: int = 3


def bits_per_character(value: bytes) -> float:
    counts = np.bincount(np.frombuffer(value, np.uint8))
    share = counts[counts > 0] / len(value)
    return float(-(share * np.log2(share)).sum())


def looks_random(value: bytes, kind: str, limits: Limits) -> bool:
    if PLACEHOLDER.search(value.lower()):
        return False
    if kind != "opaque":
        return bits_per_character(value) >= limits.bits_in_context
    digits = sum(48 <= c <= 57 for c in value)
    letters = sum(c >= 65 and c not in b"_" for c in value)
    return digits >= limits.digits_alone and letters > 0 and bits_per_character(value) >= limits.bits_alone


def spans(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, number of kind, end, value) of all matches by start and kind, in bytes; each kind's are leftmost and don't overlap."""
    found = []
    for m in ASSIGN.finditer(text.lower()):
        if m.end(1) - m.start(1) >= LEAST_VALUE:
            found.append((m.start(), 0, m.end(), text[m.start(1) : m.end(1)]))
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    found.sort()
    # Opaque strings beside, not inside or around, what the other kinds found.
    taken, reach = [], 0
    for start, _, end, _ in found:
        reach = max(reach, end)
        taken.append((start, reach))
    starts = np.array([s for s, _ in taken], np.int64)
    for m in OPAQUE.finditer(text):
        before = int(np.searchsorted(starts, m.end())) - 1
        if before < 0 or taken[before][1] <= m.start():
            found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


def code_points(text: bytes, places: list[int]) -> list[int]:
    """Numbers of characters before the given byte places."""
    if text.isascii() or not places:
        return places
    characters = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return [int(characters[p - 1]) if p else 0 for p in places]


SECRETS = "array<struct<start:long,kind:string,end:long,n_owners:long,n_repositories:long,live:boolean>>"
_FOUND = "array<struct<start:long,kind:int,end:long,digest:binary,random:boolean>>"


def _scan(docs: DataFrame, limits: Limits) -> DataFrame:
    """doc_id, doc, th, owner, repository, found: spans with digests of their values, of every row."""
    kind = pa.list_(
        pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("digest", pa.binary()), ("random", pa.bool_())])
    )

    def one(text: str | None) -> list[dict]:
        raw = text.encode() if text else b""
        out = []
        listed = [(*s, looks_random(s[3], KINDS[s[1]], limits)) for s in spans(raw)]
        listed = [s for s in listed if s[1] < 3 or s[4]]
        starts, ends = code_points(raw, [s[0] for s in listed]), code_points(raw, [s[2] for s in listed])
        for (_, k, _, value, random), start, end in zip(listed, starts, ends, strict=True):
            digest = hashlib.blake2b(value, digest_size=16).digest()
            out.append({"start": start, "kind": k, "end": end, "digest": digest, "random": random})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([one(t.as_py()) for t in batch["text"]], kind)
            names = ["doc_id", "doc", "th", "owner", "repository"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], found], [*names, "found"])

    return docs.mapInArrow(run, f"doc_id long, doc long, th long, owner string, repository string, found {_FOUND}")


def holders(found: DataFrame) -> DataFrame:
    """digest, n_owners, n_repositories, n of `found` (digest, owner, repository): who holds a value, and how often it stands.

    Rows are combined before each shuffle, so a value that stands everywhere costs a task no more than
    a row per owner and task. A null owner is one owner, a null repository one repository of its owner.
    """
    by_place = found.groupBy("digest", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_place.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("r").alias("n_repositories"), F.sum("n").alias("n")
    )


def _with_holders(places: DataFrame, counted: DataFrame) -> DataFrame:
    """`places` with their value's counts; rows of very common values don't meet in one task."""
    bound = max((counted.agg(F.sum("n")).first()[0] or 0) // COMMON, LEAST_COMMON)
    common = counted.where(F.col("n") > bound)
    rare = counted.where(F.col("n") <= bound)
    marked = places.join(F.broadcast(common.select("digest", F.lit(True).alias("is_common"))), "digest", "left")
    return (
        marked.where("is_common").drop("is_common").join(F.broadcast(common), "digest")
        .unionByName(marked.where("is_common IS NULL").drop("is_common").join(rare, "digest"))
    )


def find_secrets(docs: DataFrame, owner: Column, repository: Column, limits: Limits = Limits()) -> DataFrame:
    """doc_id and secrets array<struct<start, kind, end, n_owners, n_repositories, live>>, a row per row of `docs`.

    `docs` has doc_id and text; `owner` and `repository` are expressions over its columns, and other columns
    don't matter. start and end count code points. Secrets stand by start, then in the order of KINDS;
    opaque strings are listed only if live. Null and empty texts have none. Repeated rows are rows of
    their own with equal secrets. Rows without an owner belong to one unknown owner.
    """
    named = docs.select(
        "doc_id", F.coalesce("doc_id", F.lit(NULL_KEY)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
        owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), "text",
    )
    scanned = stage(_scan(named, limits))
    each = scanned.select("doc", "th", "owner", "repository", F.explode("found").alias("s")).select("doc", "th", "owner", "repository", "s.*")
    counted = stage(holders(each))
    # Equal texts of one doc_id have equal answers: one place for them all.
    places = each.groupBy("doc", "th", "start", "kind", "end", "digest").agg(F.first("random").alias("random"))
    live = F.col("random") & (F.col("n_owners") <= limits.owners) & (F.col("n_repositories") <= limits.repositories)
    judged = _with_holders(places, counted).withColumn("live", live).where((F.col("kind") < 3) | F.col("live"))
    answers = judged.groupBy("doc", "th").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "n_owners", "n_repositories", "live"))).alias("secrets")
    )
    rows = scanned.select("doc_id", "doc", "th").join(answers, ["doc", "th"], "left")

    def named(x: Column) -> Column:
        kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)
        return F.struct(x["start"].alias("start"), kind.alias("kind"), *[x[c].alias(c) for c in ("end", "n_owners", "n_repositories", "live")])

    return rows.select("doc_id", F.coalesce(F.transform("secrets", named), F.array().cast(SECRETS)).alias("secrets"))


def listed(secrets: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(secrets, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


@query("op11_secret_scan")
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; a source is an owner, its documents of one language are a repository."""
    found = find_secrets(read(spark, sf_dir, "documents"), F.col("source"), F.col("lang"))
    secrets = F.col("secrets")

    def count(test) -> Column:
        return F.size(F.filter(secrets, test)).cast("long")

    def of_kind(kind: str):
        return lambda x: x["kind"] == kind

    base = F.filter(secrets, lambda x: x["kind"] != KINDS[3])
    return found.select(
        "doc_id",
        *[count(of_kind(k)).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(secrets).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"),
        count(lambda x: x["n_owners"] > Limits.owners).alias("n_copied"),
        listed(F.filter(secrets, lambda x: x["live"])).alias("live_spans"),
    )
