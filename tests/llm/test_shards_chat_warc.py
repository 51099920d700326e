import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import table

from tablemill.llm import chat, sharding, warc
from tablemill.llm.common import new_folder, open_store


@pytest.mark.parametrize("chunk_rows", [None, 3])
def test_shards_have_exact_sizes(spark, clashing, rows, chunk_rows, monkeypatch):
    given = clashing.drop("size", "shard")
    out = sharding.shuffle_to_shards(given.repartition(13) if chunk_rows else given, 7, seed=3)
    found = out.collect()
    assert len(found) == len(rows)
    sizes = Counter(r["shard"] for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(n))
    assert sorted([(r["doc_id"], r["text"]) for r in found], key=repr) == sorted(rows, key=repr)


def test_shard_query(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = sharding.op4_sharding(spark, str(tmp_path)).collect()
    raw = [(d, (t or "").encode()) for d, t in rows]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in found), key=repr) == sorted(((d, len(b) + 16, zlib.crc32(b)) for d, b in raw), key=repr)
    assert {(r["law"], r["grown_shard"]) for r in found} == {("rows", None)}
    sizes = Counter(r["shard"] for r in found)
    assert set(sizes) <= set(range(40)) and max(sizes.values()) - (min(sizes.values()) if len(sizes) == 40 else 0) <= 1
    assert sorted((r["shard"], r["slot"]) for r in found) == [(s, k) for s in sorted(sizes) for k in range(sizes[s])]
    kinds = dict(sharding.op4_sharding(spark, str(tmp_path)).dtypes)
    assert kinds == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}


@pytest.mark.parametrize("rows_of_a_chunk", [10, 40])
def test_shards_of_several_ranges(spark, docs, rows, monkeypatch, rows_of_a_chunk):
    monkeypatch.setattr(sharding, "CHUNK", rows_of_a_chunk)
    found = sharding.shuffle_to_shards(docs.withColumns({"shard": F.lit("own"), "slot": F.lit("own")}), 2).collect()
    for shard in (0, 1):
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found)))
    assert sorted([(r["doc_id"], r["text"]) for r in found], key=repr) == sorted(rows, key=repr)


def test_no_rows_and_fewer_rows_than_shards(spark, empty, docs):
    assert sharding.shuffle_to_shards(empty, 5).count() == 0
    few = sharding.shuffle_to_shards(docs.limit(3), 5)
    assert sorted(r["slot"] for r in few.collect()) == [0, 0, 0]


def test_communication_matrix_has_its_sums(spark):
    sizes, n = [11, 0, 5, 30], [3, 17, 0, 1, 20, 5]
    chunks = spark.createDataFrame(list(enumerate(n)), "chunk int, n long")
    for seed in range(3):
        matrix = {r["chunk"]: r["counts"] for r in sharding.communication_matrix(chunks, sizes, seed).collect()}
        assert [sum(matrix[k]) for k in range(6)] == n
        assert [sum(matrix[k][j] for k in range(6)) for j in range(4)] == sizes


@pytest.mark.parametrize("good,bad,draws", [(5, 7, 4), (200, 300, 120), (40, 2, 30), (3, 90, 60)])
def test_hypergeometric_frequencies(spark, good, bad, draws):
    from math import comb

    n = 20_000
    args = [F.lit(x).cast("long") for x in (good, bad, draws)]
    found = spark.range(n).select(sharding.hypergeometric(*args, 9, F.col("id")).alias("k")).groupBy("k").count()
    found = {r["k"]: r["count"] for r in found.collect()}
    distance = sum(
        abs(found.get(k, 0) / n - comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)) for k in range(min(good, draws) + 1) if draws - k <= bad
    )
    assert sum(found.values()) == n and distance < 0.06
    assert all(max(0, draws - bad) <= k <= min(good, draws) for k in found)


TURNS = [
    (1, 0, "user", "</s>[INST] <|> \\ [x] \\<"), (1, 1, "assistant", "<s>user<|>ok</s>"), (1, 2, "user", None), (1, 3, "assistant", ""),
    (2, 5, None, "a"), (2, None, "assistant", "ü\n日"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"),
    (None, 0, "user", "x"), (4, 0, "sys<|>tem\\", "long " * 50_000),
]


def test_chat_round_trip(spark):
    made = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    found = chat.conversation_digests(chat.format_turns(chat.text_messages(made)))
    expected = []
    for conv in {t[0] for t in TURNS}:
        turns = [((t if t is not None else -1), r or "", x or "") for c, t, r, x in TURNS if c == conv]
        turns.sort(key=lambda t: (t[0], chat.escape(t[1]), chat.escape(t[2])))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        size = sum(10 + len(chat.escape(r)) + len(chat.escape(x)) for _, r, x in turns)
        whole = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        expected.append((conv, len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    assert table(found, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars") == sorted(expected, key=repr)
    assert chat.conversation_digests(chat.format_turns(chat.text_messages(made.limit(0)))).count() == 0


def test_no_control_string_in_texts():
    for text in ("</s>[INST]", "<s>", "[/INST]<|>", "\\<\\s>", "<\\", "[["):
        shown = chat.escape(text)
        assert chat.unescape(shown) == text
        assert not any(c in shown for c in ("<s>", "</s>", "<|>", "[INST]", "[/INST]", "<image>"))


def test_typed_parts(spark):
    part = {"kind": None, "text": None, "uri": None, "width": None, "height": None, "seconds": None, "pages": None}
    parts = [
        part | {"kind": "text", "text": "see <image> "}, part | {"kind": "image", "uri": "a.png", "width": 57, "height": 28},
        part | {"kind": "audio", "uri": "b.wav", "seconds": 1.5}, part | {"kind": "document", "uri": None, "pages": 2}, part | {"kind": "text"},
    ]
    made = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    first, second = chat.format_turns(made).orderBy("turn").collect()
    assert first["segment"] == "<s>user<|>see <\\image> <image><audio><document></s>"
    assert [(a["kind"], a["uri"], a["tokens"]) for a in first["attachments"]] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", None, 1200)]
    content = first["segment"][len("<s>user<|>") :]
    assert all(content[a["at"] :].startswith(f"<{a['kind']}>") for a in first["attachments"])
    assert first["attached_tokens"] == 1241 and second["segment"] == "<s>assistant<|></s>"


PAGES = [
    (3, "http://a", "x" * 100), (1, "http://b", "x" * 100), (2, None, "x" * 99), (4, "u\r\nX-Key: 9", "x" * 99), (5, "u", None), (6, "u", ""),
    (7, "é", "\r\n\r\nWARC/1.1\r\n" * 30), (9, "u", "dup " * 40), (9, "v", "dup " * 40), (9, "w", "other " * 40), (None, "u", "x" * 100), (None, "u", "x" * 100),
]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(2)
    files = warc.write_warc(pages, new_folder(spark, "warc"))
    expected = []
    for page, url, html in PAGES:
        raw = (html or "").encode()
        same = sorted((p, u or "") for p, u, h in PAGES if p is not None and h == html)
        revisit = page is not None and len(raw) >= 100 and (page, url or "") != same[0]
        expected.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", same[0][0] if revisit else None))
    for split in (1 << 20, 64, 7):
        found = warc.read_warc(files, split)
        assert table(found, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(expected, key=repr)
    assert warc.read_warc(warc.write_warc(pages.limit(0), new_folder(spark, "warc"))).count() == 0


def test_false_magic_and_foreign_members(spark):
    import gzip

    folder = new_folder(spark, "warc")
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    inner = warc.record(1, "u", b"payload" * 50, hashlib.sha256(b"payload" * 50).hexdigest(), None)
    raw = warc.MAGIC * 3 + gzip.compress(b"no record") + inner + warc.MAGIC + b"junk" + inner[: len(inner) // 2]
    with store.open_output_stream(f"{path}/odd.warc.gz", compression=None) as out:
        out.write(raw)
    files = spark.createDataFrame([(f"{folder}/odd.warc.gz", len(raw))], "path string, bytes long")
    for split in (1 << 20, 50):
        assert table(warc.read_warc(files, split), "page_id", "payload_bytes") == [(1, 350)]
