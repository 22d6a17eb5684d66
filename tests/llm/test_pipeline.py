"""The stages of corpus_pipeline.py one by one against plain models, and run() as their chain."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from offerloom.llm import langid, line_rules, near_dup, tokens

SYLLABLES = {
    "en": "the and ing ter with house people water light green".split(),
    "de": "und der keit schaf ung haus leute wasser licht grün".split(),
    "fr": "les des tion ment avec maison gens eau lumière verte".split(),
}


def prose(rng, lang, n):
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    lines = [" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, n, 12)]
    return "\n".join(lines)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        lang = rng.choice(list(SYLLABLES))
        rows.append([i, prose(rng, lang, rng.randrange(40, 200)), lang, rng.choice(["web", "books", None]), 0])
    for i in range(30):
        # Exact copies, and near ones that differ in two words of many.
        text = rows[i][1]
        if i % 2:
            words = text.split(" ")
            words[len(words) // 3] = f"other{i}"
            text = " ".join(words)
        rows.append([240 + i, text, rows[i][2], "web", 0])
    rows += [[300, None, "en", "web", 0], [301, "", "en", "web", 0], [302, "½ ²³ 12345 ___", "en", None, 0], [303, "Home | About | Contact\n" * 30, "en", "web", 0], [304, "word " * 200, "en", "web", 0]]
    rows += [rows[5], rows[5]]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def kept(spark, folder):
    """What each stage leaves, as rows, and the last stage's rows."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        out.append(docs.collect())
    return out


def test_stages_have_the_columns_of_documents(spark, folder, kept):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "mixture", "sequences"]
    for rows in kept[:-1]:
        assert rows and list(rows[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_and_quality(spark, folder, kept):
    docs = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    lesson = spark.read.parquet(f"{folder}/documents.parquet").filter(langid.remainder(5) != 0)
    rejected = langid.judge_texts(langid.fit(lesson), [d["text"] for d in docs])[2]
    want = Counter((d["doc_id"], d["text"]) for d, r in zip(docs, rejected, strict=True) if not r)
    assert Counter((r["doc_id"], r["text"]) for r in kept[0]) == want
    ids = {r["doc_id"] for r in kept[0]}
    assert not ids & {300, 301, 302} and len(ids & set(range(270))) >= 262
    judged = line_rules.judge(spark.createDataFrame(kept[0])).filter("kept").collect()
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in kept[1]) == Counter((r["doc_id"], r["clean_text"], len(r["clean_text"])) for r in judged)
    assert not {r["doc_id"] for r in kept[1]} & {303, 304}


def test_one_document_of_each_class_stays(kept):
    rows = sorted({(r["doc_id"], r["text"]) for r in kept[1]})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(a, b) for a in range(len(rows)) for b in range(a)]
    for (a, b), s in zip(pairs, near_dup.similarities([rows[a][1] for a, _ in pairs], [rows[b][1] for _, b in pairs]), strict=True):
        if s >= 0.8:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    want = {rows[find(i)] for i in range(len(rows))}
    assert {(r["doc_id"], r["text"]) for r in kept[2]} == want and len(kept[2]) == len(want) < len(rows) - 20


def test_mixture_takes_words_of_its_documents(kept):
    words = {r["doc_id"]: (r["text"].split(), r["source"], r["lang"]) for r in kept[2]}
    size, taken = defaultdict(int), defaultdict(int)
    for w, source, _ in words.values():
        size[source] += len(w)
    for r in kept[3]:
        w, source, lang = words[r["doc_id"]]
        part = r["text"].split()
        assert (r["source"], r["lang"]) == (source, lang) and r["n_chars"] == len(r["text"]) and part
        assert any(w[i : i + len(part)] == part for i in range(len(w) - len(part) + 1))
        taken[source] += len(part)
    from offerloom.llm import mixing

    targets = mixing.targets(dict(size))
    assert all(abs(taken[s] - targets[s]) <= 2 * 1024 for s in size)


def test_sequences_hold_every_token_once(kept):
    plain = Tokenizer.from_file(tokens.default_tokenizer())
    want = Counter()
    for r in kept[3]:
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or min(1024, len(ids))
        starts = [0, *range(first, len(ids), 1024)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            raw = b"".join(int(i).to_bytes(4, "little") for i in ids[a:b])
            want[r["doc_id"], k, a, b - a, zlib.crc32(raw)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in kept[4]) == want
    by = defaultdict(list)
    for r in kept[4]:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024


def test_run_is_the_chain_of_the_stages(spark, folder, kept):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, folder).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(tuple(r[c] for c in columns) for r in kept[4])


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, node long, kept boolean, shard int"
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0 and empty.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0
    rng = random.Random(8)
    rows = [(i % 40, prose(rng, "en", 60), "en", None, None, 0.5, 1, 2, True, 3) for i in range(50)] + [(None, prose(rng, "de", 60), None, "a", None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    assert corpus_pipeline.STAGES[1][1](spark, docs, "").count() <= 51
    for name, stage in corpus_pipeline.STAGES[2:]:
        assert stage(spark, docs, "").count() > 0, name
    assert docs.filter(F.col("doc_id").isNull()).count() == 1
