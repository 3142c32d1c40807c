import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.orc as orc
import pytest
from tokenizers import Tokenizer

from colloquy.llm import encoding, packing, textscan, token_files
from colloquy.llm.encoding import Encoder, vocabulary

from .helpers import edge_docs, edge_rows, empty_docs


def library(name):
    t = Tokenizer.from_file(vocabulary(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("name", "lower"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_encoder_gives_the_ids_of_the_library(name, lower):
    r = random.Random(3)
    atoms = ["'s", "'S", "a", " ", "  ", "\n", "\t", "é", "é", "É", "1", "²", "½", "!", "_", "ß", "İ", "\x1c", "\x00", "\xa0", "日", "’", "–", "<|endoftext|>", "ǅ", "ſ", "€", " \n ", "'ll", "×"]
    texts = ["".join(r.choice(atoms) for _ in range(r.randint(0, 12))) for _ in range(6000)]
    encode, plain = Encoder(vocabulary(name), lower), library(name)
    for _ in range(2):  # new words, then known ones
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [plain(t) for t in texts]


THUE = ["a", "b"]
while len(THUE[0]) < 2048:
    THUE = [THUE[0] + THUE[1], THUE[1] + THUE[0]]


@pytest.mark.parametrize(("name", "lower"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_added_tokens_and_equal_codes(name, lower, monkeypatch):
    """Strings of added tokens are what the library makes of them; pre-tokens with one code are told apart by their bytes."""
    texts = ["hello <|endoftext|> world", "<|startoftext|>a", "a<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext", *THUE]
    texts += [w[:n] for w in THUE for n in (1024, 257, 256, 255, 64)] + ["abcdefghi jklmnopqrs", "abcdefgh abcdefghi abcdefgh"]
    plain = library(name)
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(vocabulary(name), lower)(texts)] == [plain(t) for t in texts]
    real = encoding.range_codes
    monkeypatch.setattr(encoding, "range_codes", lambda data, start, end: np.where(end - start <= 8, real(data, start, end), np.uint64(77)))
    encode = Encoder(vocabulary(name), lower)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [plain(t) for t in texts]


def test_range_codes():
    r = random.Random(7)
    data = np.frombuffer("".join(r.choice("ab") for _ in range(3000)).encode() + b"\0" * 40, np.uint8)
    start = np.array([r.randrange(len(data)) for _ in range(4000)])
    end = np.minimum(start + np.array([r.choice([0, 1, 7, 8, 9, 17, 300]) for _ in start]), len(data))
    codes = textscan.range_codes(data, start, end).tolist()
    ranges = [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    assert len(set(zip(codes, ranges, strict=True))) == len(set(codes)) == len(set(ranges))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_files_round_trip(spark, docs):
    plain = library("byte_bpe_50k.json")
    path = token_files.write_tokens(docs)
    found = {r.doc_id: r for r in token_files.read_digest(spark, path).collect()}
    start = 0
    for row in docs.orderBy("doc_id").select("doc_id", "text").collect():
        ids = [*plain(row.text), 0]
        got = found[row.doc_id]
        assert (got.start, got.n_tokens, got.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    files = sorted(spark.read.orc(path).inputFiles())
    ids = [orc.ORCFile(f.removeprefix("file://")).read(["doc_id"]).column(0).to_pylist() for f in files]
    assert [x for f in ids for x in f] == sorted(found)


def test_files_of_edge_cases(spark):
    plain = library("byte_bpe_50k.json")
    rows = token_files.read_digest(spark, token_files.write_tokens(edge_docs(spark))).collect()
    order = sorted(((i, t) for i, t, *_ in edge_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for (i, t), r in zip(order, sorted(rows, key=lambda r: r.start), strict=True):
        ids = [*plain(t), 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), crc(ids))
        start += len(ids)
    assert token_files.read_digest(spark, token_files.write_tokens(empty_docs(spark))).count() == 0


def rows_read(df):
    """Rows that the scan hands on, after what the files' metadata rules out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName().startswith("AdaptiveSparkPlan") else plan
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_lookups_skip_files_stripes_and_rows(spark, tmp_path):
    """The doc_ids of a range of rows alternate, so only the Bloom filter can tell that one is missing."""
    rows = spark.range(0, 40_000, 2).selectExpr("id as doc_id", "concat('document ', id) as text")
    path = token_files.write_tokens(rows, f"{tmp_path}/tokens", stripe_bytes=1 << 14)
    one = orc.ORCFile(sorted(f.removeprefix("file://") for f in spark.read.orc(path).inputFiles())[0])
    assert one.nstripes > 1 and one.row_index_stride == 1000
    assert rows_read(spark.read.orc(path)) == 20_000
    found = token_files.read_documents(spark, path, [10_000, 30_002])
    assert sorted((r.doc_id, r.n_tokens) for r in found.collect()) == sorted((i, len(library("byte_bpe_50k.json")(f"document {i}")) + 1) for i in (10_000, 30_002))
    assert 0 < rows_read(found) <= 4_000
    assert rows_read(token_files.read_documents(spark, path, [50_000])) == 0
    missing = token_files.read_documents(spark, path, [10_001])
    assert missing.count() == 0 and rows_read(missing) <= 1_000


def test_first_fit_takes_the_first_bin_with_room():
    r = random.Random(5)
    for _ in range(50):
        sizes = sorted((r.randint(1, 100) for _ in range(r.randint(1, 60))), reverse=True)
        room, want = [], []
        for s in sizes:
            at = next((i for i, x in enumerate(room) if x >= s), len(room))
            if at == len(room):
                room.append(100)
            want.append((at, 100 - room[at]))
            room[at] -= s
        bins, offsets = packing.first_fit(np.array(sizes), 100)
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == want


def check_packing(rows, texts, length):
    plain = library("word_bpe_49k.json")
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        end = 0
        for offset, size in sorted(spans):
            assert offset == end
            end += size
        assert end <= length
    want = sorted((crc(ids[a : a + length]), a, len(ids[a : a + length]), len(ids)) for ids in ([*plain(t), 2] for t in texts) for a in range(0, len(ids), length))
    assert sorted((r.ids_crc32, r.start, r.length, r.doc_tokens) for r in rows) == want
    return places


def test_packing(docs):
    rows = packing.pack(docs, rests_per_group=60).collect()
    places = check_packing(rows, [r.text for r in docs.collect()], 4096)
    used = sum(n for spans in places.values() for _, n in spans)
    assert used / (4096 * len(places)) > 0.9


def test_groups_of_long_documents_are_no_larger(spark):
    """Documents of 59 pieces: only their rests are dealt to groups."""
    text = " ".join(f"word{i}" for i in range(640))
    docs = spark.createDataFrame([(i, f"{text} {'x ' * (i % 9)}") for i in range(60)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs, length=32, rests_per_group=10).collect()
    places = check_packing(rows, [r.text for r in docs.collect()], 32)
    assert len(rows) > 50 * 60
    groups = Counter(r.sequence_id >> 32 for r in rows if r.length < 32)
    assert max(groups.values()) <= 25 and all(r.sequence_id < 0 and r.offset == 0 for r in rows if r.length == 32)
    used = sum(n for spans in places.values() for _, n in spans)
    assert used / (32 * len(places)) > 0.97


def test_packing_edge_cases(spark):
    check_packing(packing.pack(edge_docs(spark), length=64).collect(), [r[1] for r in edge_rows()], 64)
    assert packing.pack(empty_docs(spark)).count() == 0
