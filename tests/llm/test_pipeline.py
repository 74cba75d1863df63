import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rowloom.llm.langid import identify, train

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "PII", "best-fit packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def brute(spark, docs):
    from test_pii import PATTERNS, luhn
    from test_simhash import brute as linked, slow_fingerprint

    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    good = {r["doc_id"] for r in identify(docs, model).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    rows = {i: t for i, t in rows.items() if i in good}
    groups = defaultdict(list)
    for i, t in rows.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append(i)
    rows = {i: rows[i] for i in (min(g, key=lambda i: (-len(rows[i]), i)) for g in groups.values())}
    top = linked({i: slow_fingerprint(t) for i, t in rows.items()})
    rows = {i: t for i, t in rows.items() if top[i] == i}

    def masked(text):
        for kind, p in PATTERNS.items():
            def put(m, kind=kind):
                d = re.sub("[^0-9]", "", m[0])
                ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
                return f"<{kind.upper()}>" if ok else m[0]

            text = re.sub(p, put, text)
        return text

    return {i: masked(t) for i, t in rows.items()}


@pytest.fixture(scope="module")
def want(spark):
    return brute(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def test_run_against_brute_force(spark, want):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Counter()
    for i, t in want.items():
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            pieces[(i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces


def test_stages_one_by_one(spark, want, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        before, docs = docs.count(), spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == columns and 0 < docs.count() <= before
    assert {r["doc_id"]: hashlib.md5(r["text"].encode()).hexdigest() for r in docs.collect()} == {i: hashlib.md5(t.encode()).hexdigest() for i, t in want.items()}
    assert docs.where("n_chars <> char_length(text)").count() == 0


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_tables_lose_no_text_and_keep_no_copy(spark, odd_rows):
    english = "the quick brown fox jumps over the lazy dog and runs away from the old house near the river number {} again"
    rows = [*odd_rows, *((i, english.format(i)) for i in range(100, 160)), (100, english.format(5000)), (100, english.format(5000)), (None, english.format(101)), (None, english.format(7000)), (104, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, k string, th string, digest int, _rl_old int"
    docs = spark.createDataFrame([(i, t, "en", None, None, "x", "y", 1, 2) for i, t in rows], schema)
    seen = []
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, SF)
        seen.append(sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str))
        assert docs.schema.names == [f.split()[0] for f in schema.split(", ")]
    assert all(t and any(c.isalpha() for c in t) for _, t in seen[0])
    plain = [re.sub(r"[\x20\x09-\x0D]", "", t) for _, t in seen[1]]
    assert len(set(plain)) == len(plain) and set(plain) == {re.sub(r"[\x20\x09-\x0D]", "", t) for _, t in seen[0]}
    near = corpus_pipeline.near(spark, docs, SF)
    private = corpus_pipeline.private(spark, near, SF)
    assert private.count() == near.count() > 0
    pieces = corpus_pipeline.packed(spark, private, SF).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in near.collect()}
