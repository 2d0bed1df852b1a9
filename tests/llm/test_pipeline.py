"""Each stage of the pipeline on a small corpus, its decisions against brute force."""

import random
import re

import corpus_pipeline
from tests.llm.test_corpus_operators import brute_components


def corpus():
    rng = random.Random(11)
    vocab = {"xx": [f"k{a}{b}m" for a in "aeiou" for b in "rstlnd"], "yy": [f"b{a}{b}sch" for a in "äöüie" for b in "rgtkpf"]}
    text = lambda lang, n: " ".join(rng.choices(vocab[lang], k=n))
    items = [(i, text("xx", 30)) for i in range(3)]
    rows = [[i, text(x := ("xx", "yy")[i % 2], rng.randint(20, 120)), x] for i in range(80)]
    for i in range(5):
        rows.append([100 + i, rows[i][1], rows[i][2]])  # copies
    rows[6][1] += " " + items[1][1]
    rows[8][1] += " mail me at joe@site.example or 10.20.30.40 "
    rows += [[200, None, None], [201, "", "xx"], [202, "12 34 !!", "yy"], [None, text("xx", 40), "xx"]]
    return [(i, t, lang, f"s{k % 3}", len(t or "")) for k, (i, t, lang) in enumerate(rows)], items


def test_stages(spark, tmp_path):
    rows, items = corpus()
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), [{r[0]: r[1] for r in rows}]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert docs.columns == columns
            kept.append({r.doc_id: r.text for r in docs.collect()})
    all_, tagged, unique, clean, redacted = kept
    assert tagged == {i: t for i, t in all_.items() if re.search("[a-z]", t or "")}
    component, _ = brute_components([(i, t) for i, t in tagged.items() if i is not None], 5, 80)
    assert unique == {i: t for i, t in tagged.items() if i is None or component[i] == i}
    assert clean == {i: t for i, t in unique.items() if i != 6}
    assert redacted == {i: t.replace("joe@site.example", "[EMAIL]").replace("10.20.30.40", "[IP]") for i, t in clean.items()}
    assert {r.doc_id for r in docs.collect()} == set(redacted)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_rows_without_an_id_and_ids_on_several_texts(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choices([f"k{a}{b}m" for a in "aeiou" for b in "rstlnd"], k=n))
    item, a, b, c, d, e = text(30), text(40), text(50), text(60), text(70), text(45)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def decided(stage, rows):
        docs = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        docs = corpus_pipeline.saved(docs.repartition(3), "rows")
        return sorted(((r.doc_id, r.text) for r in stage(spark, docs, str(tmp_path)).collect()), key=str)

    # an id on two texts, copies among rows without an id, and one of a row with an id
    rows = [(3, a), (7, a), (7, b), (None, c), (None, c), (None, c + " more"), (None, d), (9, d), (9, d), (11, e), (11, e + " more")]
    assert decided(corpus_pipeline.deduplicate, rows) in [sorted([(3, a), (7, b), (None, x), (9, d), (11, y)], key=str) for x in (c, c + " more") for y in (e, e + " more")]
    rows = [(None, a + " " + item), (None, b), (7, c + " " + item), (7, d), (8, e), (8, e)]
    assert decided(corpus_pipeline.decontaminate, rows) == sorted([(None, b), (7, d), (8, e), (8, e)], key=str)


def test_keys_that_meet_lose_no_document(spark, tmp_path, monkeypatch):
    """All short keys alike: numbers still differ, and both stages decide as ever."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    text = lambda n: " ".join(rng.choices([f"k{a}{b}m" for a in "aeiou" for b in "rstlnd"], k=n))
    item = text(30)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, text(40)) for i in range(8)] + [(20, None), (None, None), (21, ""), (22, item), (5, "5"), (5, "=5\n=5")]
    docs = spark.createDataFrame([(i, t, "xx", "s", 0) for i, t in [*rows, *rows[:3], (30, rows[4][1])]], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    monkeypatch.setattr(corpus_pipeline, "short_key", lambda key: F.lit(7).cast("long") + 0 * F.length(key))
    numbers = {(r.doc_id, r.text): r.n for r in corpus_pipeline.numbered(docs, "n").collect()}
    assert len(numbers) == len(set(numbers.values())) == len(rows) + 1
    told = lambda stage: sorted(((r.doc_id, r.text) for r in stage(spark, docs, str(tmp_path)).collect()), key=str)
    assert told(corpus_pipeline.deduplicate) == sorted(rows, key=str)
    assert told(corpus_pipeline.decontaminate) == sorted([r for r in [*rows, *rows[:3], (30, rows[4][1])] if r != (22, item)], key=str)


def test_rows_alike_but_for_other_columns(spark, tmp_path):
    rows = [(1, "one text of a few words", "xx", s, n) for s, n in (("b", 1), (None, 9), ("a", 2), (None, 5))] + [(2, "another text that is not alike", None, "z", None), (2, "another text that is not alike", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: tuple(r)[2:] for r in corpus_pipeline.deduplicate(spark, docs, str(tmp_path)).collect()}
    assert got == {1: ("xx", None, 5), 2: (None, None, None)}


def test_stages_pass_columns_of_any_name_through(spark, tmp_path):
    """Columns named as those that the operators make, nulls in all of them, repeated rows, and texts below and above the language threshold."""
    names = ["row_key", "base", "more", "pii", "score", "lang_pred", "n_words", "n_switches", "told", "h", "seed", "component_id", "__text", "runs", "TEXT_"]
    rng = random.Random(6)
    xx, yy = ([f"{c}{a}{b}m" for a in "aeiou" for b in "rstlnd"] for c in ("k", "z"))
    text = lambda v, n: " ".join(rng.choices(v, k=n))
    item = text(xx, 30)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, text(v, 40) + " at a@b.co", lang) for i, (v, lang) in enumerate([(xx, "xx"), (yy, "yy")] * 20)]
    rows += [(50, item, "xx"), (51, None, "xx"), (52, "", None), (0, rows[0][1], "xx"), (None, rows[1][1], None)]
    full = [(*r, None, len(r[1] or ""), *(f"{n}{i}" if i % 3 else None for n in names)) for i, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(full, schema).repartition(2)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        by = {(r.doc_id, r.text): r for r in got.collect()}
        want = {(r[0], r[1]): r for r in full}
        if name == "language":
            assert {k for k in want if k not in by} == {(51, None), (52, "")}
        elif name == "deduplicate":
            assert {k for k in want if k not in by} == {(None, rows[1][1])}
        elif name == "decontaminate":
            assert {k for k in want if k not in by} == {(50, item)}
        else:
            assert {k[1] for k in by if k[0] == 0} == {rows[0][1].replace("a@b.co", "[EMAIL]")}
            continue
        assert all(tuple(by[k])[5:] in {f[5:] for f in full if (f[0], f[1]) == k} for k in by)
    assert corpus_pipeline.packing(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == 44


def test_texts_of_no_known_language_go(spark, tmp_path):
    """Each learned language has a third of a text of three: below LEAST_SHARE, so the text goes; one of a single language stays."""
    rng = random.Random(7)
    vocab = {x: [f"{x}{a}{b}{x}" for a in "aeiou" for b in "aeiou"] for x in ("kt", "brz", "wlm")}
    rows = [(i, " ".join(rng.choices(vocab[x], k=30)), x, None, 0) for i, x in enumerate([*vocab] * 60)]
    rows += [(900, " ".join(w for ws in zip(*(vocab[x] for x in vocab)) for w in ws), None, None, 0), (901, " ".join(vocab["kt"]), None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()}
    assert 901 in kept and 900 not in kept and len(kept) == len(rows) - 1
