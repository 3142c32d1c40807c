import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from colloquy.llm import toxicity
from colloquy.llm.encoding import vocabulary

from .helpers import near_classes, words
from .test_mixing import shared_targets

TEXT = "{} river stone walks over the quiet hill with {} lamps and seven {} boats near the old mill where {} children sing"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, near copies and insults, from three sources."""
    path = tmp_path_factory.mktemp("corpus")
    rows = []
    for i in range(90):
        text = " ".join(TEXT.format(f"a{i}x{k}", f"b{i}x{k}", f"c{i}x{k}", f"d{i}x{k}") for k in range(1 + i % 5))
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    rows += [(100 + i, rows[i][1].replace(" ", "  "), "en", "src0", 0) for i in range(10)]
    rows += [(200 + i, rows[i + 3][1] + " tail" * (i % 2), "en", "src1", 0) for i in range(0, 40, 5)]
    rows += [(300 + i, f"you stupid idiot {rows[i][1]} you worthless moron", "en", "src2", 0) for i in range(12)]
    rows.append((400, None, None, None, None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(300 <= i < 400)) for i, *_ in rows if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_against_a_plain_version(spark, folder):
    path, rows = folder
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).where("predicted = 1").collect()}
    assert toxic == {r[0] for r in rows if 300 <= r[0] < 400}

    left = [r for r in rows if r[0] not in toxic]
    groups = defaultdict(list)
    for r in left:
        groups["".join(words(r[1]))].append((-len(r[1] or ""), r[0]))
    left = [r for r in left if r[0] in {min(g)[1] for g in groups.values()}]
    leads = {c for _, c, *_ in near_classes([r[:2] for r in left])}
    left = [r for r in left if r[0] in leads]

    totals = defaultdict(int)
    for r in left:
        totals[r[3]] += len(words(r[1]))
    wanted = shared_targets(totals)
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in left}

    found = corpus_pipeline.run(spark, path).collect()
    copies = defaultdict(int)
    for r in found:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
        copies[r.doc_id] += r.length
    taken = defaultdict(int)
    for r in left:
        n = copies.pop(r[0], 0)
        assert n % len(ids[r[0]]) == 0 and n <= 3 * len(ids[r[0]])
        taken[r[3]] += n // len(ids[r[0]]) * len(words(r[1]))
    assert not copies
    longest = max(len(words(r[1])) for r in left)
    for source, target in wanted.items():
        assert target - 1 <= taken[source] < target + longest


def test_stages_keep_the_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns


def test_every_operator_is_registered():
    known = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in known) for i in range(1, 11)) and "pipeline" in known
    assert corpus_pipeline.ORACLE_SQL is None
