"""Operators that judge each text by itself, against brute force."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest

from pricelens.llm import chat_format, decontaminate, language_id, license_scan, packing, pii

KINDS = ("email", "ip", "card", "phone")
PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(zip(KINDS, PATTERNS)) for m in re.finditer(p, text) if passes(kind, m.group())]
    return [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def test_pii_base_spans_are_those_of_the_plain_patterns(spark, tmp_path):
    rng = random.Random(5)
    bits = ["a", "b.", "@", "x@y.z", ".", "-", "+1", " ", "(", "555", ")", "4111111111111111", "1.2.3.4", "256", "é", "😀", "%", "_", "12 34", "\n", "call ", "555-1234", "0"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    rows += [(-1, None), (-2, ""), (-3, "1 " * 2000), (-4, "+1" + "." * 3000), (-5, "x@y." * 100 + "z"), (-6, "write to joe [at] example [dot] com or call (212) 555-0187"), (None, "a@b.co"), (7, rows[7][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op1_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        want = base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        assert set(want) <= set(r.spans.split(",")) or not want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in KINDS]
    assert "phone:" in next(r.spans for r in got if r.doc_id == -6)


def brute_pii_model(rows):
    """Expectation-maximisation over vote patterns, and the classifier's weights, with numpy."""
    out = {}
    for kind in {r[0] for r in rows}:
        n = {}
        for k, code, t, bucket, m in rows:
            if k == kind and t == 0:
                n[code] = n.get(code, 0) + m
        codes = sorted(n)
        v = np.array([[code // 3**j % 3 - 1 for j in range(pii.LABELERS)] for code in codes])
        w = np.array([n[c] for c in codes], float)
        prior, p = 0.5, np.array([[0.8] * pii.LABELERS, [0.2] * pii.LABELERS])

        def posterior(prior, p):
            like = [np.prod(np.where(v == 1, x, np.where(v == 0, 1 - x, 1.0)), axis=1) for x in p]
            return prior * like[0] / (prior * like[0] + (1 - prior) * like[1])

        for _ in range(pii.ROUNDS):
            q = posterior(prior, p)
            p = np.array([[((z * (v[:, j] == 1)).sum() + add) / ((z * (v[:, j] >= 0)).sum() + 5) for j in range(pii.LABELERS)] for z, add in ((w * q, 4), (w * (1 - q), 1))])
            prior = ((w * q).sum() + 1) / (w.sum() + 2)
        q = dict(zip(codes, posterior(prior, p)))
        ys, xs = sum(n[c] * q[c] for c in codes), sum(n[c] * (1 - q[c]) for c in codes)
        out[kind, -1, 0] = np.log((ys + 0.5) / (xs + 0.5))
        for t, bucket in {(r[2], r[3]) for r in rows if r[0] == kind}:
            mine = [(r[1], r[4]) for r in rows if r[0] == kind and r[2:4] == (t, bucket)]
            y, x = sum(m * q[c] for c, m in mine), sum(m * (1 - q[c]) for c, m in mine)
            out[kind, t, bucket] = np.log((y + 0.1) / (ys + 0.1 * pii.BUCKETS)) - np.log((x + 0.1) / (xs + 0.1 * pii.BUCKETS))
    return out


def test_pii_reliabilities_and_classifier_against_numpy(spark):
    rng = random.Random(15)
    rows = []
    for kind in (0, 3, 4):
        for _ in range(15):
            code, n = rng.randrange(3**pii.LABELERS), rng.randint(1, 50)
            rows += [(kind, code, t, rng.randrange(6), n) for t in range(pii.FEATURES)]
    totals = {}
    for r in rows:
        totals[r[:4]] = totals.get(r[:4], 0) + r[4]
    rows = [(*k, n) for k, n in totals.items()]
    got = {(r.kind, r.t, r.bucket): r.w for r in pii.weights(spark.createDataFrame(rows, "kind int, code int, t int, bucket int, n long")).collect()}
    want = brute_pii_model(rows)
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_secrets_and_accounts(spark):
    texts = ['api key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', "bank account DE89 3704 0044 0532 0130 00 now", "bank account DE88 3704 0044 0532 0130 00 now", "a-perfectly-ordinary-slug-with-many-words", "token: ghp_abcdEFGH1234ijklMNOP5678qrstUVWX9012"]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts * 5)), "doc_id int, text string")).collect()
    kinds = [sorted({pii.KINDS[x.kind] for x in r.pii} & {"secret", "iban"}) for r in sorted(got, key=lambda r: r.doc_id)]
    assert kinds[:5] == [["secret"], ["iban"], [], [], ["secret"]]


def test_redaction_of_clashing_names_and_many_spans(spark):
    text = "x 1.2.3.4 y joe@site.example " * 400
    df = spark.createDataFrame([(1, text, "b", "m", "p", "t", "r"), (1, text, "b", "m", "p", "t", "r"), (None, "+1 (212) 555-0187 a@b.co", None, "", "", "", "")], "doc_id long, text string, base string, more string, pii string, __text string, runs string")
    got = pii.redact(df).collect()
    assert pii.redact(df).columns == df.columns
    assert sorted((r.text for r in got), key=len) == ["[PHONE] [EMAIL]", *["x [IP] y [EMAIL] " * 400] * 2]
    assert [r.base for r in sorted(got, key=lambda r: len(r.text))] == [None, "b", "b"]


def test_many_spans_in_time_with_their_number(spark):
    """30,000 spans of two kinds in one text, all found and taken out; each pair tested, or each run cut out of the whole text, would take minutes."""
    text = " ".join(f"+1 (212) 555-{i % 10000:04d} me{i}@site.example" for i in range(15_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (row,) = pii.redact(df).collect()
    assert row.text == " ".join(["[PHONE] [EMAIL]"] * 15_000) and time.time() - began < 90


def test_bisection(spark):
    from pyspark.sql import functions as F

    xs = [1, 3, 3, 7, 20]
    df = spark.createDataFrame([(xs[:n], v) for n in range(6) for v in range(22)], "xs array<int>, v int")
    assert all(r.n == sum(x < r.v for x in r.xs) for r in df.select("xs", "v", pii.below(F.col("xs"), F.col("v")).alias("n")).collect())


def test_redaction_takes_spans_out_and_leaves_the_rest(spark):
    df = spark.createDataFrame([(1, "mail a@b.co now, 4111111111111111."), (2, "clean text"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {1: "mail [EMAIL] now, [CARD].", 2: "clean text", 3: None, 4: ""}


def test_pii_of_an_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string, kind string")).collect() == []


def test_leaks_survive_substitutions_and_spare_clean_text(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 40)))) for i in range(20)] + [(99, "too short"), (98, None)]
    docs, want = [], {}
    for i in range(60):
        words = [word() for _ in range(80)]
        if i % 3 == 0:
            item, passage = rng.choice(items[:20])
            passage = passage.split()
            if i % 2:  # every seventh token replaced
                passage = [word() if k % 7 == 3 else w for k, w in enumerate(passage)]
            words[30:30] = passage
            want[i] = item
        docs.append((i, " ".join(w.upper() if i % 5 == 0 else w for w in words) + ("!" if i % 2 else "")))
    docs += [(100, None), (101, ""), (102, "one")]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.item_id for r in got} == want
    assert all(r.start == 30 and r.score >= decontaminate.LEAST for r in got)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), none).collect() == []


def brute_leaks(docs, items):
    """All diagonals of each document and item: windows that a mask lets through, and the best stretch on their diagonal."""
    tokens = lambda t: [x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x]
    out = {}
    for i, text in docs:
        d = tokens(text)
        for j, item in items:
            b = tokens(item)
            if 0 < len(b) < decontaminate.LEAST:
                if d == b:
                    out[i, j] = len(b)
                continue
            for shift in range(-len(b) + 1, len(d)):
                same = [(k, d[k + shift] == b[k]) for k in range(len(b)) if 0 <= k + shift < len(d)]
                hit = any(all(same[a + x][1] for x in decontaminate.taken(m)) for m in decontaminate.MASKS for a in range(len(same) - decontaminate.SPAN + 1))
                run = best = 0
                for _, ok in same if hit else ():
                    run = max(run, 0) + (1 if ok else -decontaminate.MISMATCH)
                    best = max(best, run)
                if best >= decontaminate.LEAST:
                    out[i, j] = max(best, out.get((i, j), 0))
    return out


def test_leaks_against_all_diagonals(spark):
    rng = random.Random(12)
    few = [f"t{i}" for i in range(5)]
    items = [(i, " ".join(rng.choices(few + [f"u{k}" for k in range(60)], k=rng.randint(1, 30)))) for i in range(12)] + [(70, "t1 t2"), (71, ""), (72, None), (73, "The END"), (None, "t1 u1 " * 6)]
    docs = [(i, " ".join(w if rng.random() < 0.85 else rng.choice(few) for w in (rng.choice(items[:12])[1] + " " + rng.choice(items[:12])[1]).split())) for i in range(40)]
    docs += [(100, "t1, T2!"), (101, None), (102, ""), (103, "the end"), (None, items[3][1] + " u1"), (None, items[4][1]), (104, "t1 u1 " * 20), (105, docs[0][1]), (105, docs[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, h int").repartition(3)
    got = {}
    for r in decontaminate.leaks(df, spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, seed int")).collect():
        got[r.doc_id, r.item_id] = r.score
    want = brute_leaks([d for d in docs if d[0] is not None], items)
    for (_, text), key in zip((d for d in docs if d[0] is None), ("x", "y")):
        for (_, j), score in brute_leaks([(key, text)], items).items():
            want[None, j] = max(score, want.get((None, j), 0))
    assert got == want and len(want) > 20


def test_long_items_and_documents(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM", 300)
    rng = random.Random(13)
    words = [f"w{rng.randrange(10**6)}" for _ in range(8000)]
    docs = spark.createDataFrame([(1, " ".join(words[2900:2950])), (2, " ".join(words[290:305])), (3, " ".join(rng.choices(words, k=30_000)))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.leaks(docs, items).collect()) == [1, 2]


def test_leaks_in_parts_are_those_in_one(spark, monkeypatch):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(50))), (2, " ".join(f"v{i}" for i in range(50)))], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(f"{'wv'[i % 2]}{k}" for k in range(i, i + 15))) for i in range(8)], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "WINDOWS_A_PART", 100)
    assert sorted(map(tuple, decontaminate.leaks(docs, items).collect())) == whole and len(whole) == 8
    monkeypatch.setattr(decontaminate, "MOST_PARTS", 0)  # by a shuffle of windows, and with nothing broadcast
    monkeypatch.setattr(decontaminate, "SENT", 0)
    assert sorted(map(tuple, decontaminate.leaks(docs, items).collect())) == whole


def test_repeated_tokens_on_both_sides(spark):
    """Long runs of one token, with an odd one among them, and of three: each diagonal once, whatever the windows in it."""
    docs = [(1, "a " * 20_000), (2, "a " * 3000 + "b " + "a " * 3000), (3, "x y z " * 2000), (4, "q " * 8), (5, "a " * 8)]
    items = [(7, "a " * 4096), (8, "a " * 500 + "c " + "a " * 700), (9, "x y z " * 300)]
    got = {(r.doc_id, r.item_id): tuple(r)[2:] for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 7): (4096, 4096, 0, 4096), (1, 8): (1198, 1200, 0, 1201), (2, 7): (4093, 4095, 0, 4096), (2, 8): (1198, 1200, 0, 1201), (3, 9): (900, 900, 0, 900)}


def test_repeated_tokens_against_all_diagonals(spark):
    rng = random.Random(21)
    docs = [(i, " ".join(rng.choices("ab", weights=(9, 1), k=rng.randint(5, 60)))) for i in range(25)]
    items = [(i, " ".join(rng.choices("ab", weights=(9, 1), k=rng.randint(9, 40)))) for i in range(8)]
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_leaks(docs, items)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    scores, start, step, n = rng.normal(size=(9, 3)), rng.normal(size=3), rng.normal(size=(3, 3)), [4, 5]
    got, _, _ = language_id.forward_backward(scores, np.array(n), start, step)
    for at, k in ((0, 4), (4, 5)):
        want = np.zeros((k, 3))
        for path in itertools.product(range(3), repeat=k):
            w = np.exp(start[path[0]] + sum(scores[at + i, y] for i, y in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                want[i, y] += w
        assert np.allclose(got[at : at + k], want / want.sum(1, keepdims=True))


def test_language_of_held_out_and_odd_texts(spark, tmp_path):
    vocab = {"xx": ["kama", "kolo", "tiku", "kiran"], "yy": ["brust", "grend", "blomp", "frost"]}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(vocab[x := ("xx", "yy")[i % 2]], k=20)), x) for i in range(200)]
    rows += [(1000, None, "xx"), (1001, "", None), (1002, "123 !!", "yy"), (1003, "kama " * 5000, None), (None, "brust grend", "yy")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in language_id.op3_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == x for i, _, x in rows[:200])
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "xx", "yy"]
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.language_id(empty).collect() == []


def test_switches_within_a_text():
    crf = language_id.fit([("kama kolo tiku kiran " * 8, "xx"), ("brust grend blomp frost " * 8, "yy")] * 20)
    ((lang, share, words, switches),) = language_id.Tagger(crf).tag(["kama kolo tiku kama kolo brust grend blomp"])
    assert (lang, words, switches) == ("xx", 8, 1) and share < 0.8


@pytest.mark.parametrize("text,labels", [("Released under the MIT License.", "mit"), ("released under the MIT licence", "mit"), ("Apache License, Version 2.0", "apache-2"), ("CC BY-NC 4.0", "cc-by-nc"), ("licensed under cc by sa", ""), ("under the bsd license", ""), ("", ""), (None, ""), ("This is the GNU Generl Public License", "gpl")])
def test_license_labels(text, labels):
    assert license_scan.Scanner().scan(None if text is None else text.encode())["labels"] == labels


def brute_notices(text):
    """What fuzzy() finds, by edit distances of all runs of words."""
    def distances(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i, *row[1:]] if (old := row) else []
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        return row[-1]

    words, out = text.split(), []
    for notice, label, needed in license_scan.NOTICES:
        k = max(1, min(license_scan.MOST_EDITS, len(notice) // license_scan.CHARS_PER_EDIT))
        runs = [(i, j, " ".join(words[i:j])) for i in range(len(words)) for j in range(i + 1, len(words) + 1)]
        runs = [(distances(notice, run), i, j) for i, j, run in runs if abs(len(run) - len(notice)) <= k and set(needed) <= set(words[i:j])]
        taken = []
        for edits, i, j in sorted(r for r in runs if r[0] <= k):
            if all(j <= a or b <= i for a, b in taken):
                taken.append((i, j))
                out.append((label, i, j - 1, edits))
    return sorted(out)


def test_license_notices_that_adjoin():
    scanner = license_scan.Scanner()
    found = lambda text: sorted(scanner.fuzzy(b" " + text.encode() + b" "))
    assert scanner.scan(b"undr the apache licence version 2 under the apache license version 3")["labels"] == "apache-2"
    assert found("undr the mit license under the mit license under the mit licence") == [("mit", 0, 3, 1), ("mit", 4, 7, 0), ("mit", 8, 11, 1)]
    rng = random.Random(21)
    notices = [n for n, _, _ in license_scan.NOTICES if len(n) < 45]
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 3)):
            x = list(rng.choice(notices))
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "e", "2", " ", "x "])
            parts += ["".join(x), *rng.choices(["the", "2", "mit"], k=rng.randint(0, 1))]
        text = " ".join(" ".join(parts).split())
        assert found(text) == brute_notices(text), text


def test_license_scan_of_dense_long_texts_is_linear_and_takes_notices(spark):
    import time

    scanner, times = license_scan.Scanner(), []
    for n in (2000, 8000):
        text = b"under the mit license and " * n
        began = time.time()
        got = scanner.scan(text)
        times.append(time.time() - began)
        assert (got["n_base"], got["last_word"], len(got["spans"])) == (n, 5 * (n - 1), n)
    assert times[1] < 8 * times[0] + 0.5
    df = spark.createDataFrame([(1, "use it as you lik"), (2, "nothing")], "doc_id long, text string")
    assert [r.labels for r in license_scan.license_scan(df, notices=[("use it as you like", "own", ())]).collect()] == ["own", ""]
    assert license_scan.license_scan(df.filter("false")).collect() == []


def test_license_base_against_words(spark):
    rng = random.Random(3)
    bits = ["under", "the", "MIT", "license", "cc", "by", "nc", "é", "x", ",", "-", "\n", "under the mit license", "cc by nc cc by nc"]
    rows = [(i, " ".join(rng.choices(bits, k=rng.randint(0, 12)))) for i in range(200)] + [(None, None), (-1, "ccé by nc"), (3, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "labels")
    got = license_scan.license_scan(df, text_col="labels").collect()
    for (_, text), r in zip(rows, got, strict=True):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(i, label) for phrase, label in license_scan.BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None)), text
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_chats_come_back(spark):
    rng = random.Random(4)
    odd = ["\\### Assistant: </turn> ok", "<|end|>", "<|turn|>", "\\l", "\\s", "\\", "<", "a\nb", "", "😀é", None]
    rows = [(c, rng.randint(0, 3), rng.choice(["user", "assistant", "system", None, "<|x|>"]), rng.choice(odd)) for c in range(30) for _ in range(rng.randint(1, 8))]
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:3]], "conv_id long, turn long, role string, text string, turns string")
    got = chat_format.parse_chats(chat_format.format_chats(df)).collect()
    for r in got:
        mine = sorted(((t, role or "", text or "") for c, t, role, text in rows + rows[:3] if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in mine]
        masked = [chat_format_unescape(r.formatted[s.start : s.start + s.length]) for s in r.loss_spans]
        assert masked == [x[2] for x in mine if x[1] == "assistant"]
    assert chat_format.format_chats(df.filter("false")).collect() == []


def test_loss_is_what_the_mask_covers_in_a_long_conversation(spark):
    rng = random.Random(14)
    rows = [(1, i, rng.choice(["assistant", "user"]), rng.choice(["<é>", "\\", "", "ok ok", None])) for i in range(3000)]
    df = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    (r,) = df.withColumn("loss", chat_format.masked(df["formatted"], df["loss_spans"])).collect()
    assert r.loss == "".join(t or "" for _, _, role, t in rows if role == "assistant")
    assert len(r.loss_spans) == sum(role == "assistant" for _, _, role, _ in rows)


def chat_format_unescape(text):
    return text.replace("\\l", "<").replace("\\s", "\\")


def test_encoder_agrees_with_tokenizers():
    from tokenizers import Tokenizer

    path = packing.public_tokenizer()
    slow, fast, rng = Tokenizer.from_file(path), packing.Encoder(path), random.Random(6)
    bits = ["hello", " World", "\n", "  ", "\t", "é", "日本", "😀", "123", "!!", "'s", "<|endoftext|>", " ", "\x1c", "naïve", "a" * 50]
    for _ in range(300):
        text = "".join(rng.choices(bits, k=rng.randint(0, 20)))
        assert fast.encode(text).tolist() == [*slow.encode(text, add_special_tokens=False).ids, 1], text
    long = "word " * 120_000
    assert fast.encode(long).tolist() == [*slow.encode(long, add_special_tokens=False).ids, 1]


def test_long_texts_are_cut_where_tokens_end(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "LONG", 7)
    path = packing.public_tokenizer()
    slow, fast, rng = Tokenizer.from_file(path), packing.Encoder(path), random.Random(16)
    bits = ["hello", " World", "\n", "  ", " ", "é", " 日本", "😀", " 12", "!!", "'s", " 's", "<|endoftext|>", "a b c", "naïve ", "²", "_x", "e\u0301 f", "\u00a0"]
    for _ in range(400):
        text = "".join(rng.choices(bits, k=rng.randint(0, 30)))
        assert fast.encode(text).tolist() == [*slow.encode(text, add_special_tokens=False).ids, 1], text


def test_pieces_go_to_the_cheapest_sequence_with_room():
    rng = random.Random(17)
    for trial in range(200):
        length, last = rng.choice([8, 16]), trial % 2 == 0
        pieces = [(d, 0, rng.randint(1, 40)) for d in range(rng.randint(1, 12))]
        total = sum(n for _, _, n in pieces)
        rest = total % length if last else 0
        room = [length] * (total // length) + [2**b for b in (3, 2, 1, 0) if rest & 2**b]
        cost, used, want, left = [0.0] * len(room), [0] * len(room), [], []
        queue = sorted(((min(length, n - k), d, k) for d, _, n in pieces for k in range(0, n, length)), key=lambda x: (-x[0], x[1], x[2]))
        for n, d, a in queue:
            while n:
                able = [s for s in range(len(room)) if room[s] - used[s] >= n] or [s for s in range(len(room)) if room[s] > used[s]]
                if not able:
                    left.append((d, a, n))
                    break
                s = min(able, key=lambda s: (cost[s], s))
                k = min(n, room[s] - used[s])
                want.append((d, a, k, s, used[s]))
                used[s] += k
                cost[s] += packing.LINEAR * k + packing.QUADRATIC * k * k
                n, a = n - k, a + k
        assert packing.assign(pieces, length, last) == (want, left)
        assert used == room and sum(n for *_, n in left) == total - sum(room)


def test_packing_across_shards_and_an_empty_table(spark, monkeypatch):
    rows = [(i, "alpha " * (i % 700), 9) for i in range(300)] + [(5, "alpha " * 5, 9)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").coalesce(1)
    assert packing.pack(df.filter("false"), packing.public_tokenizer()).collect() == []
    monkeypatch.setattr(packing, "SHARD", 20_000)
    got = packing.pack(df, packing.public_tokenizer()).collect()
    sizes = {}
    for r in got:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert sum(n != 2048 for n in sizes.values()) <= 11  # only a task's last sequences are short
    assert sum(sizes.values()) == sum(len(packing.Encoder(packing.public_tokenizer()).encode(t)) for _, t, _ in rows)


def test_packing_loses_nothing_and_pads_nothing(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma,"], k=rng.randint(0, 3000)))) for i in range(60)] + [(100, None), (101, ""), (None, "x"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = packing.pack(df, packing.public_tokenizer()).collect()
    encoder = packing.Encoder(packing.public_tokenizer())
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length
    for i, text in rows:
        ids = encoder.encode(text or "")
        assert b"".join(bytes(r.ids) for r in sorted(by_doc[i, len(ids)], key=lambda r: r.start)) == ids.tobytes()
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
