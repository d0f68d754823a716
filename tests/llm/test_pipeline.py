"""The pipeline's stages against plain Python over a small corpus."""

import random

import pytest
from conftest_llm import prose, vocabulary
from test_operators import junk, plain_components, plain_pii, plain_scan, plain_simhash, plain_targets

import corpus_pipeline
from lineaframe.llm import near_copies, quality


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    words = vocabulary(3000, 22)
    bench = [(i, prose(rng, 30, words)) for i in range(5)]
    rows = []
    for i in range(240):
        text = prose(rng, rng.randrange(30, 200), words)
        if i % 8 == 0:
            text = junk(rng, 120)
        elif i % 8 == 1:
            text = rows[-1][1]
        elif i % 8 == 2:
            text += " " + bench[i % 5][1]
        elif i % 8 == 3:
            text += " reach me at a.b@c-d.org or +49 30 1234567"
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    rows += [(900, None, None, None, None), (901, "", "en", "s1", 0), (None, "some text without any id at all", "en", None, 31), rows[20], rows[20]]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, 0 if i % 8 == 0 else 1, 0) for i in range(240) if i % 8 != 1]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, bench


def test_stages(spark, corpus):
    path, bench = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "mixing"]
    before = None
    for name, stage in corpus_pipeline.STAGES:
        given = docs.collect()
        out = stage(spark, docs, path)
        rows = out.collect()
        got = sorted((tuple(r[:5]) for r in rows), key=str)
        if name == "quality":
            net = quality.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
            want = [tuple(r) for r in given if net.score(r["text"]) >= 0.7]
            junky = [r for r in got if r[0] is not None and r[0] < 240 and r[0] % 8 == 0]
            assert len(junky) <= 2 and len([r for r in got if r[0] is not None and r[0] < 240 and r[0] % 8 > 1]) >= 175
        elif name == "near_dedup":
            prints = [plain_simhash(r["text"]) for r in given]
            root = plain_components(set(prints))
            best: dict = {}
            for r, p in zip(given, prints, strict=True):
                key = (r["doc_id"] is None, r["doc_id"] or 0)
                if root[p] not in best or key < best[root[p]][0]:
                    best[root[p]] = (key, tuple(r))
            want = [r for _, r in best.values()]
        elif name == "decontamination":
            want = [tuple(r) for r in given if not plain_scan(r["text"], bench)[1]]
            assert len(want) < len(given)
        elif name == "pii":
            want = []
            for r in given:
                text, spans = r["text"], sorted(plain_pii(r["text"]), key=lambda s: -s[1])
                for kind, start, end in spans:
                    text = text[:start] + f"[{kind.upper()}]" + text[end:]
                want.append((r["doc_id"], text, r["lang"], r["source"], len(text) if spans else r["n_chars"]))
            assert any("[EMAIL]" in (r[1] or "") and "[PHONE]" in r[1] for r in want)
        else:
            sizes, words = {}, lambda t: (t or "").split()
            for r in given:
                sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
            targets, taken, whole = plain_targets(sizes, (5, 2, 1), 1.5, 2.0), dict.fromkeys(sizes, 0), {tuple(r)[1] for r in given}
            for r in rows:
                assert r["words"] == len(words(r["text"])) and r["n_chars"] == len(r["text"]) and r["target"] == pytest.approx(targets[r["source"]])
                taken[r["source"]] += r["words"]
                if r["text"] not in whole:  # a part: a run of the words of its document, wrapped round
                    own = next(words(g["text"]) for g in given if (g["doc_id"], g["source"]) == (r["doc_id"], r["source"]))
                    assert " ".join(own + own).find(r["text"]) >= 0
            assert all(abs(taken[s] - targets[s]) <= 3 + 0.02 * targets[s] for s in sizes)
            assert max(sum(r["doc_id"] == i for r in rows) for i in {r["doc_id"] for r in rows if r["doc_id"] != 20}) <= 2
            want = got
        assert got == sorted(want, key=str), name
        if name != "mixing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        before = len(rows)
        docs = spark.createDataFrame(rows, out.schema)
    assert before == corpus_pipeline.run(spark, path).count()


def test_empty_corpus(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)


@pytest.mark.parametrize("part", [near_copies.PART, 3])
def test_near_copies_go(spark, monkeypatch, part):
    """The stage against all pairs of five-word shingle sets, also with nodes dealt out in small blocks."""
    monkeypatch.setattr(near_copies, "PART", part)
    rng = random.Random(41)
    many = vocabulary(4000, 42)

    def edited(text, n):
        words = text.split()
        for at in rng.sample(range(len(words)), n):
            words[at] = rng.choice(many)
        return " ".join(words)

    texts = [None, "", "one two", "One  two", "one three"]
    for n in range(40):
        base = prose(rng, rng.randrange(40, 300), many)
        texts += [base] + [edited(base, max(1, len(base.split()) * (n % 8) // 100)) for _ in range(3)]
    hot = prose(rng, 200, many)
    texts += [edited(hot, 1 + k % 6) for k in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = corpus_pipeline.near_dedup_stage(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(root))
