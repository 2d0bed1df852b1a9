"""Personal data by weak supervision, with DataFrame functions alone.

Spans that the base patterns find and that pass their checks always count.
Looser patterns, and base matches that failed, are candidates besides. Labelers
- patterns, checks, gazetteers, context - vote on every span; expectation-
maximisation over the counted vote patterns estimates how far each labeler can
be trusted; the resulting probabilities train the final classifier, a naive
Bayes over features of the span, which decides on the candidates.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_runs, let, query, saved, table, unused

#: The kinds that have base patterns, then those that only the method finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban")
#: Base patterns with possessive loops: none gives back what it took, which changes no match and keeps time linear in the text.
#: A run of fewer than 12 digits is no card and is part of no longer run, so only longer ones are looked for.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms: addresses spelled out, IPv6, card numbers with other separators, national phone numbers; keys and tokens; bank accounts.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9./])",
    "phone": r"(?<![0-9A-Za-z+(.-])(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z.-])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+={0,2}+(?![A-Za-z0-9_+/=-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: What a text must hold for a pattern to be looked for at all.
MARKS = {"email": "@", "phone": r"\+[0-9]", "email_loose": r"[\[(]at[\])]", "ip": r"[0-9]\.[0-9]", "ip_loose": r"[0-9A-Fa-f]:[0-9A-Fa-f]", "iban_loose": r"[A-Z]{2}[0-9]{2}"}
#: Gazetteers: what an address, number or card of the kind tends to have.
KNOWN = {
    "email": r"(?i)(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|io|info|de|fr|es|uk|us|eu|ch|at|it|nl)$",
    "ip": r"^(?!0|255|22[4-9]|23[0-9]|24[0-9]|25[0-5])",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "secret": r"^(?:AKIA|gh[pousr]_|glpat-|xox[abprs]-|sk-|sk_|pk_|AIza|eyJ)|^(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$|^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).{32,}$",
    "iban": r"^(?:AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|SM|TR)",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
}
#: Words before a span that speak for its kind, and those that speak against any.
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|mail|correo|courriel)\W*(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:\bip\b|host|server|address|from|client)\W*(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\W*(?:\w+\W+){0,2}$",
    "secret": r"(?i)(?:token|key|secret|passw(?:or)?d|passwd|pwd|api|bearer|auth|authorization|credentials?)\W*(?:\w+\W+)?$",
    "iban": r"(?i)(?:iban|account|konto|cuenta|compte|bank)\W*(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:phone|call|tel|mobile|cell|fax|dial|telefon|sms)\W*(?:\w+\W+){0,2}$",
}
AGAINST = r"(?i)(?:order|isbn|version|serial|invoice|part|item|ticket|sku|id|no|number|ref)\W*$"
CONTEXT, LABELERS, BUCKETS, FEATURES = 32, 5, 64, 4
ROUNDS, SURE = 25, 0.9


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes: every second digit from the right doubled, 9 taken off above 9."""
    n = F.length(number)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when((n - i) % 2 == 1, F.pmod(2 * F.substring(number, i, F.lit(1)).cast("int") - 1, F.lit(9)) + F.when(F.substring(number, i, F.lit(1)) == "0", -8).otherwise(1)).otherwise(F.substring(number, i, F.lit(1)).cast("int")))
    return (n > 0) & (total % 10 == 0)


def valid(kind: str, m: Column) -> Column:
    """The base's checks."""
    if kind == "ip":
        return m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)(?:\.|$)){4}$")
    if kind == "card":
        return F.length(digits(m)).between(12, 19) & luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    if kind == "secret":
        # random enough: letters and several digits, and many different characters
        return m.rlike("[A-Za-z]") & (F.length(digits(m)) >= 4) & (F.size(F.array_distinct(F.split(m, ""))) >= 10)
    if kind == "iban":
        bare = F.regexp_replace(m, " ", "")
        turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
        number = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda acc, c: (acc * F.when(number(c) > 9, 100).otherwise(10) + number(c)) % 97)
        return F.length(bare).between(15, 34) & (rest == 1)
    return F.lit(True)


def found(text: Column, pattern: str) -> Column:
    """Array of (start, end, m, before) of all matches: what is between matches, and the matches, add up to positions.

    Added up by runs of matches, then within each: appending to one array
    for thousands of matches would take time with their square.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans_ = F.array().cast("array<struct<start:int,end:int,m:string,before:string>>")
    size = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + F.length(x["gap"]), acc["at"] + size(x)
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), F.right(x["gap"], F.lit(CONTEXT)).alias("before"))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    lengths = lambda runs: F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda acc, x: acc + size(x)))
    starts = lambda runs: F.aggregate(lengths(runs), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    walked = lambda r: F.aggregate(r["run"], F.struct(r["at"].alias("at"), spans_.alias("out")), step)["out"]
    return let(in_runs(F.arrays_zip(gaps.alias("gap"), hits.alias("m"))), lambda runs: F.flatten(F.transform(F.arrays_zip(runs.alias("run"), F.slice(starts(runs), F.lit(1), F.size(runs)).alias("at")), walked)))


def votes(kind: str, x: Column, strict: bool) -> list[Column]:
    """1, 0 or -1 (abstains) of each labeler: base pattern and checks, checks alone, gazetteer, context, surroundings."""
    m, before = x["m"], x["before"]
    bare = digits(m) if kind == "card" else m
    check = valid(kind, m) if kind != "ip" or strict else F.lit(True)
    if kind == "phone":
        check = F.length(digits(m)).between(7, 15) & (F.length(F.array_join(F.array_distinct(F.split(digits(m), "")), "")) > 2)
    yes = lambda c: F.when(c, 1).otherwise(0)
    return [
        yes(valid(kind, m)) if strict else F.lit(0 if kind in BASE_KINDS else -1),
        yes(check),
        F.when(bare.rlike(KNOWN[kind]), 1).otherwise(0 if kind in ("card", "phone", "secret", "iban") else -1),
        F.when(before.rlike(CUES[kind]), 1).when(before.rlike(AGAINST), 0).otherwise(-1),
        yes(~before.rlike(r"[A-Za-z0-9_=/#]$")),
    ]


def code(vs: list[Column]) -> Column:
    """Votes as a number to base 3."""
    return reduce(add, (((v + 1) * 3**j) for j, v in enumerate(vs)))


def features(k: int, kind: str, x: Column, vs: list[Column]) -> list[Column]:
    """FEATURES buckets of a span: its shape, the word before it, its length, what check and gazetteer say."""
    shape = F.regexp_replace(F.regexp_replace(x["m"], "[0-9]+", "9"), "[A-Za-z]+", "a")
    word = F.lower(F.regexp_extract(x["before"], r"(\w*)\W*$", 1))
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    return [hashed(shape), hashed(word), F.least(F.length(x["m"]), F.lit(BUCKETS - 1)), (vs[1] + 1) * 3 + vs[2] + 1]


def judged(k: int, kind: str, x: Column, strict: bool) -> Column:
    vs = votes(kind, x, strict)
    return F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), F.lit(strict).alias("strict"), code(vs).alias("code"), F.array(*features(k, kind, x, vs)).alias("features"))


def below(xs: Column, v: Column) -> Column:
    """How many of xs, in ascending order, are less than v, by bisection."""

    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        less = F.get(xs, mid) < v
        done = acc["lo"] >= acc["hi"]
        return F.struct(F.when(done | ~less, acc["lo"]).otherwise(mid + 1).alias("lo"), F.when(done | less, acc["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(xs) + 1.0)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(xs).alias("hi")), halve)["lo"]


def ends_of(spans: Column) -> Column:
    """Where each of spans begins and ends. Of one pattern's spans, none of which overlap, both ascend."""
    return F.struct(F.transform(spans, lambda x: x["start"]).alias("starts"), F.transform(spans, lambda x: x["end"]).alias("ends"))


def of_kind(spans: Column, k: int, strict: bool) -> Column:
    return F.filter(spans, lambda x: (x["kind"] == k) & (x["strict"] == strict))


def met(own: Column, start: Column, until: Column) -> Column:
    """Whether one of a pattern's spans, as ends_of() has them, begins before until and ends behind start."""
    n = below(own["starts"], until)
    return (F.size(own["starts"]) > 0) & (n > 0) & (F.get(own["ends"], n - 1) > start)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def spans(docs: DataFrame, text: str, base_name: str, more_name: str) -> DataFrame:
    """docs with two arrays of spans (kind, start, end, ...): base, and more, which holds candidates clear of base spans."""
    df, base, more = docs, [], []
    names = dict(zip([*BASE_KINDS, *(f"{k}_loose" for k in KINDS)], unused([*docs.columns, base_name, more_name], *BASE_KINDS, *(f"{k}_loose" for k in KINDS))))
    none = F.array().cast("array<struct<start:int,end:int,m:string,before:string>>")
    # most texts hold no digit and no mark, and are passed over once
    marked = lambda x: F.col(text).rlike(MARKS.get(x, "[0-9]"))
    pattern = lambda x: (LOOSE if "_" in x else BASE)[x.partition("_")[0]]
    df = df.select("*", *(F.when(marked(x), found(F.col(text), pattern(x))).otherwise(none).alias(name) for x, name in names.items()))
    for k, kind in enumerate(KINDS):  # Spark calls these functions at once, so each sees its own kind
        if kind in BASE_KINDS:
            base.append(F.transform(F.filter(names[kind], lambda x: valid(kind, x["m"])), lambda x: judged(k, kind, x, True)))
            more.append(F.transform(F.filter(names[kind], lambda x: ~valid(kind, x["m"])), lambda x: judged(k, kind, x, True)))
        more.append(F.transform(names[f"{kind}_loose"], lambda x: judged(k, kind, x, False)))
    df = df.withColumn(base_name, F.array_sort(F.concat(*base)))
    ends = F.struct(*(ends_of(of_kind(F.col(base_name), k, True)).alias(kind) for k, kind in enumerate(BASE_KINDS)))
    clear = lambda own: F.filter(F.concat(*more), lambda a: ~any_of([met(own[kind], a["start"], a["end"]) for kind in BASE_KINDS]))
    return df.withColumn(more_name, let(ends, clear)).drop(*names.values())


def counted(df: DataFrame) -> DataFrame:
    """kind, code, t, bucket, n over all spans of columns base and more: at most 6 * 3**5 * 4 * 64 rows, whatever the corpus."""
    rows = df.select(F.explode(F.concat("base", "more")).alias("s"))
    rows = rows.select("s.kind", "s.code", F.posexplode("s.features").alias("t", "bucket"))
    return rows.groupBy("kind", "code", "t", "bucket").agg(F.count("*").alias("n"))


def trusted(counts: DataFrame) -> DataFrame:
    """kind, code, p: the probability that a span with these votes is personal data, by expectation-maximisation for each kind.

    The steps run within one row for each kind: an array of its vote patterns,
    3**5 at most. The start says that a labeler is right four times in five.
    """
    patterns = counts.filter("t = 0").groupBy("kind", "code").agg(F.sum("n").cast("double").alias("n"))
    item = F.struct("code", "n", F.array(*((F.floor(F.col("code") / 3**j) % 3 - 1).cast("int") for j in range(LABELERS))).alias("v"))
    df = patterns.groupBy("kind").agg(F.collect_list(item).alias("ps"))

    def likely(v: Column, p: Column) -> Column:
        """Probability of the votes, where p has that of a 1 for each labeler."""
        return reduce(lambda a, b: a * b, (F.when(F.get(v, F.lit(j)) == 1, F.get(p, F.lit(j))).when(F.get(v, F.lit(j)) == 0, 1 - F.get(p, F.lit(j))).otherwise(1.0) for j in range(LABELERS)))

    def posterior(v: Column, s: Column) -> Column:
        a, b = s["prior"] * likely(v, s["yes"]), (1 - s["prior"]) * likely(v, s["no"])
        return a / (a + b)

    def total(ps: Column, f) -> Column:
        return F.aggregate(ps, F.lit(0.0), lambda acc, x: acc + f(x))

    def step(s: Column, _: Column) -> Column:
        # the patterns' probabilities, once for all that is counted from them
        qs = F.transform("ps", lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), posterior(x["v"], s).alias("q")))
        return F.get(F.transform(F.array(qs), counted_anew), F.lit(0))

    def counted_anew(qs: Column) -> Column:
        weight = {"yes": lambda x: x["n"] * x["q"], "no": lambda x: x["n"] * (1 - x["q"])}

        def rate(j: int, which: str) -> Column:
            vote = lambda x: F.get(x["v"], F.lit(j))
            one = total(qs, lambda x: F.when(vote(x) == 1, weight[which](x)).otherwise(0.0))
            cast = total(qs, lambda x: F.when(vote(x) >= 0, weight[which](x)).otherwise(0.0))
            # pseudo-counts hold to the start's belief where there is little evidence
            return ((one + (4.0 if which == "yes" else 1.0)) / (cast + 5.0))

        prior = (total(qs, weight["yes"]) + 1) / (total(qs, lambda x: x["n"]) + 2)
        return F.struct(prior.alias("prior"), *(F.array(*(rate(j, which) for j in range(LABELERS))).alias(which) for which in ("yes", "no")))

    start = F.struct(F.lit(0.5).alias("prior"), F.array(*[F.lit(0.8)] * LABELERS).alias("yes"), F.array(*[F.lit(0.2)] * LABELERS).alias("no"))
    df = df.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step))
    return df.select("kind", F.explode("ps").alias("x"), "s").select("kind", "x.code", posterior(F.col("x.v"), F.col("s")).alias("p"))


def weights(counts: DataFrame) -> DataFrame:
    """kind, t, bucket, w: log odds of a feature, and of the kind itself where t is -1, from the labelers' probabilities as soft labels."""
    soft = counts.join(trusted(counts), ["kind", "code"])
    yes, no = F.sum(F.col("n") * F.col("p")), F.sum(F.col("n") * (1 - F.col("p")))
    each = soft.groupBy("kind", "t", "bucket").agg(yes.alias("y"), no.alias("x"))
    both = soft.filter("t = 0").groupBy("kind").agg(yes.alias("ys"), no.alias("xs"))
    odds = F.log((F.col("y") + 0.1) / (F.col("ys") + 0.1 * BUCKETS)) - F.log((F.col("x") + 0.1) / (F.col("xs") + 0.1 * BUCKETS))
    prior = F.log((F.col("ys") + 0.5) / (F.col("xs") + 0.5))
    return each.join(both, "kind").select("kind", "t", "bucket", odds.alias("w")).unionByName(both.select("kind", F.lit(-1).alias("t"), F.lit(0).alias("bucket"), prior.alias("w")))


def find_pii(docs: DataFrame, text_col: str = "text", sure: float = SURE, without: tuple[str, ...] = (), pii_col: str = "pii") -> DataFrame:
    """docs, less the columns in without, and pii_col: array of (kind, start, end, base, p), ordered by start, then kind as in KINDS.

    Positions are code points from 0, the end exclusive. Null and empty texts
    have no spans. All base spans are there (base true, p 1), and the
    candidates to which the classifier gives sure or more; of candidates that
    overlap the first by kind and start stays. Repeated rows are judged alike
    and count alike; an empty table gives none; other columns pass through,
    whatever their names, but one called pii_col is replaced. Texts are read
    once and not shuffled: the spans are written beside the columns that stay,
    and a table of counts of bounded size is all that is gathered.
    """
    docs = docs.drop(pii_col)
    text, base, more = unused([*docs.columns, pii_col], "text", "base", "more")
    df = spans(docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))), text, base, more)
    df = saved(df.drop(text, *without), "pii-spans")
    counts = saved(counted(df.select(F.col(base).alias("base"), F.col(more).alias("more"))), "pii-votes")
    # one row of bounded size, which a subquery puts beside each row: no weight is written into the plan
    size = 1 + FEATURES * BUCKETS
    place = F.col("kind") * size + F.when(F.col("t") < 0, 0).otherwise(1 + F.col("t") * BUCKETS + F.col("bucket"))
    known = F.map_from_entries(F.collect_list(F.struct(place, "w")))
    learned = weights(counts).agg(known.alias("w")).select(F.transform(F.sequence(F.lit(0), F.lit(len(KINDS) * size - 1)), lambda i: F.coalesce(F.try_element_at("w", i), F.lit(0.0))).alias("w"))
    (w,) = unused([*df.columns, pii_col], "weights")
    df = df.withColumn(w, saved(learned, "pii-weights").scalar())
    weigh = lambda x: reduce(add, (F.get(F.col(w), x["kind"] * size + 1 + t * BUCKETS + F.get(x["features"], F.lit(t))) for t in range(FEATURES)), F.get(F.col(w), x["kind"] * size))
    # a candidate also needs its own check: no classifier overrules a failed checksum
    told = F.transform(F.filter(more, lambda x: F.floor(x["code"] / 3) % 3 == 2), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["strict"].alias("strict"), (1 / (1 + F.exp(-weigh(x)))).alias("p")))
    df = df.withColumn(more, F.filter(told, lambda x: x["p"] >= sure))
    lists = [(k, strict) for k in range(len(KINDS)) for strict in (True, False)[k >= len(BASE_KINDS) :]]
    ends = F.struct(*(ends_of(of_kind(F.col(more), k, s)).alias(f"{KINDS[k]}_{s}") for k, s in lists))
    # one of an earlier kind that overlaps, or one of the same kind that began before
    beaten = lambda own, b: any_of([(b["kind"] >= k) & met(own[f"{KINDS[k]}_{s}"], b["start"], F.when(b["kind"] == k, b["start"]).otherwise(b["end"])) for k, s in lists])
    kept = let(ends, lambda own: F.filter(more, lambda b: ~beaten(own, b)))
    span = lambda x, base, p: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(base).alias("base"), p.alias("p"))
    every = F.array_sort(F.concat(F.transform(base, lambda x: span(x, True, F.lit(1.0))), F.transform(kept, lambda x: span(x, False, x["p"]))))
    return df.withColumn(pii_col, F.transform(every, lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "start", "end", "base", "p"))))).drop(w, base, more)


def listed(pii: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(pii, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of text_col replaced by its kind in brackets, as [EMAIL]; null stays null.

    A span that begins within an earlier one goes with it. Other columns pass
    through, whatever their names.
    """
    pii, runs, ends = unused(docs.columns, "pii", "runs", "ends")
    df = find_pii(docs, text_col, pii_col=pii)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = F.col(text_col)
    # spans in runs; where all spans before a run end: the text of a run is cut out once, and its pieces from that
    farthest = lambda r: F.coalesce(F.array_max(F.transform(r, lambda x: x["end"])), F.lit(0))
    last = F.aggregate(runs, F.array(F.lit(0)), lambda acc, r: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), farthest(r)))))
    df = df.withColumn(runs, in_runs(F.col(pii))).withColumn(ends, last)
    zero = lambda at: F.struct(at.alias("at"), F.array().cast("array<string>").alias("parts"))
    part = lambda c, a, n: F.struct(F.substring(c["text"], a - c["at"] + 1, n).alias("text"), a.alias("at"))

    def piece(r: Column, c: Column) -> Column:
        step = lambda acc, x: F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(x["start"] < acc["at"], acc["parts"]).otherwise(F.concat(acc["parts"], F.array(part(c, acc["at"], x["start"] - acc["at"])["text"], F.get(names, x["kind"])))).alias("parts"),
        )
        return F.array_join(F.aggregate(r, zero(c["at"]), step)["parts"], "")

    def pieces(rs: Column, i: Column) -> Column:
        """Of 64 runs together, whose text is cut out before that of each."""
        at = lambda j: F.get(ends, F.least(i * 64 + j, F.size(ends) - 1))
        whole = F.struct(text.alias("text"), F.lit(0).alias("at"))
        own = lambda c: F.transform(rs, lambda r, j: let(part(c, at(j), at(j + 1) - at(j)), lambda x: piece(r, x)))
        return let(part(whole, at(F.lit(0)), at(F.lit(64)) - at(F.lit(0))), lambda c: F.array_join(own(c), ""))

    clean = F.concat(F.array_join(F.transform(in_runs(F.col(runs)), pieces), ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))
    return df.withColumn(text_col, F.when(text.isNull() | (F.size(pii) == 0), text).otherwise(clean)).select(*docs.columns)


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), without=("text",))
    base = F.filter("pii", lambda x: x["base"])
    count = lambda k: F.size(F.filter("pii", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{KINDS[k]}")
    return df.select("doc_id", *(count(k) for k in range(len(BASE_KINDS))), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))
