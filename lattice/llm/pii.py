"""Personal data by candidate gradient boosting.

Generators with high recall propose spans, which may overlap.  Four of them are the base formats: what passes their checks
is a span whatever the model says.  All other candidates - base formats that fail a check, numbers without a plus sign,
written-out addresses, credentials - get features of format and context, a score from boosted trees, and a threshold for each
generator that is calibrated to ``PRECISION`` on examples kept from the fit.  What overlaps a stronger span is dropped.

The trees are fitted on the driver over a generated set of labelled examples (``EXAMPLES`` of them, whatever the corpus)
whose features come from the same expressions; fitted trees become SQL CASE expressions.  A text is read where it lies: no
shuffle, and nothing outside the JVM.

Defined cases: null text is empty and has no spans; offsets count code points, the end is exclusive; rows that repeat each
get a row; an empty table gives an empty result; a very long text is searched whole (what a candidate overlaps is found by comparing
it with the text's other candidates); further columns pass through, but for ``base`` and ``spans``, which are replaced.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base kinds in their fixed order, then the kinds that only the model can add.
KINDS = ("email", "ip", "card", "phone", "number", "address", "secret")
BASE = 4
EXAMPLES, TREES, PRECISION, RATE, SEED = 2400, 24, 0.98, 0.3, 2
#: Spans are counted from their neighbours in runs of this length.
RUN = 256

_LOCAL = "[A-Za-z0-9._%+-]"
#: Possessive and anchored forms that find the same leftmost matches without trying a long run again from each character.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9A-Za-z+.(-])\(?[0-9]{2,4}\)?(?:[\x20./-]\(?[0-9]{2,5}\)?){2,4}(?![0-9A-Za-z])",
    "address": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[a-z0-9-]{1,64}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[a-z0-9-]{1,64}){1,4}",
    "secret": r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?i)(?<![a-z])(?:password|passwd|secret|token|api_?key)[\"']?\x20?[=:]\x20?[\"']?[a-z0-9_/+-]{8,}+",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Cheap tests that a text with a match passes.
HINTS = {"email": "@", "phone": "+"}
CONTEXT = {
    "call": r"(?i)(?:call|tel|phone|fax|mobile|cell|dial|reach)[a-z.:]*\W{0,4}$",
    "mail": r"(?i)(?:mail|contact|write|reach)[a-z.:]*\W{0,4}$",
    "account": r"(?i)(?:card|visa|account|iban|ssn|social|passport|tax)[a-z.:#]*(?:\W+(?:no|number|id))?\W{0,4}$",
    "host": r"(?i)(?:ip|host|server|address|login|from)[a-z.:]*\W{0,4}$",
    "plain": r"(?i)(?:version|isbn|order|page|chapter|figure|fig|invoice|since|year|date|total|release|section|item|sku)[a-z.:#]*(?:\W+(?:no|number))?\W{0,4}$",
    "money": r"[$€£]\x20?$",
}
FEATURES = ("kind", "digits", "length", "breaks", "opened", "groups", "sums", *CONTEXT, "unit")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _positions(pieces: Column, found: Column) -> Column:
    """Starts of ``found``, which alternate with ``pieces``: two levels of running sums, so long lists stay cheap."""
    n = F.size(found)
    steps = F.zip_with(F.slice(pieces, 1, n), found, lambda p, m: F.struct(F.char_length(p).alias("p"), F.char_length(m).alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    total = lambda r: F.aggregate(r, F.lit(0), lambda a, s: a + s["p"] + s["m"])
    before = lambda runs: F.aggregate(runs, zero, lambda a, r: F.struct((a["at"] + total(r)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    inner = lambda r, base: F.aggregate(
        r, F.struct(base.alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, s: F.struct((a["at"] + s["p"] + s["m"]).alias("at"), F.concat(a["out"], F.array(a["at"] + s["p"])).alias("out")), lambda a: a["out"],
    )
    cut = lambda all_steps: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int")), lambda k: F.slice(all_steps, k * RUN + 1, RUN))
    return _let(_let(steps, cut), lambda runs: F.flatten(F.zip_with(runs, before(runs), inner)))


def _found(text: Column, k: int) -> Column:
    """All matches of the k-th pattern: kind, start, end, body, and the text around each."""
    kind = KINDS[k]

    def listed(v: Column) -> Column:
        n = F.size(v["found"])
        return F.zip_with(
            F.arrays_zip(_positions(v["pieces"], v["found"]).alias("at"), v["found"].alias("body")),
            F.arrays_zip(F.slice(v["pieces"], 1, n).alias("before"), F.slice(v["pieces"], 2, n).alias("after")),
            lambda m, p: F.struct(
                F.lit(k).alias("kind"), m["at"].alias("start"), (m["at"] + F.char_length(m["body"])).alias("end"), m["body"].alias("body"),
                F.right(p["before"], F.lit(32)).alias("before"), F.left(p["after"], F.lit(8)).alias("after"),
            ),
        )

    both = F.struct(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("found"), F.split(text, PATTERNS[kind], -1).alias("pieces"))
    there = text.contains(HINTS[kind]) & text.rlike(PATTERNS[kind]) if kind in HINTS else text.rlike(PATTERNS[kind])
    none = F.array().cast("array<struct<kind:int,start:int,end:int,body:string,before:string,after:string>>")
    return F.when(there, _let(both, listed)).otherwise(none)


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(acc: Column, c: Column) -> Column:
        d, i = c.cast("int"), acc["i"]
        return F.struct((acc["sum"] + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))).alias("sum"), (i + 1).alias("i"))

    figures = F.split(F.reverse(digits), "(?<=.)(?=.)")
    summed = F.aggregate(figures, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")), step, lambda a: a["sum"] % 10 == 0)
    return F.when(F.char_length(digits).between(1, 64), summed).otherwise(F.lit(False))


def _valid(c: Column) -> Column:
    """Whether a base format passes its check."""
    return (
        F.when(c["kind"] == 0, F.lit(True))
        .when(c["kind"] == 1, c["body"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(c["kind"] == 2, _luhn(_digits(c["body"])))
        .when(c["kind"] == 3, F.char_length(_digits(c["body"])).between(9, 15))
        .otherwise(F.lit(False))
    )


def _features(c: Column) -> Column:
    return _let(_digits(c["body"]), lambda digits: _described(c, digits))


def _described(c: Column, digits: Column) -> Column:
    body = c["body"]
    bit = lambda x: x.cast("int")
    values = {
        "kind": c["kind"], "digits": F.least(F.char_length(digits), F.lit(24)), "length": F.least(F.char_length(body), F.lit(40)),
        "breaks": F.least(F.char_length(F.regexp_replace(body, "[^\\x20./-]", "")), F.lit(8)), "opened": bit(body.contains("(")),
        "groups": F.coalesce(F.char_length(F.regexp_extract(body, "([0-9]+)\\D*$", 1)), F.lit(0)), "sums": bit((F.char_length(digits) >= 12) & (F.char_length(digits) <= 19) & _luhn(digits)),
        **{k: bit(c["before"].rlike(p)) for k, p in CONTEXT.items()}, "unit": bit(c["after"].rlike("(?i)^\\x20?(?:%|kg|km|usd|eur|pages?|items?|mm)")),
    }
    return F.struct(*[F.least(values[k], F.lit(64)).alias(k) for k in FEATURES])


def candidates(docs: DataFrame) -> DataFrame:
    """(row, base, others): the columns of ``docs``, the spans that pass, and the candidates for the model, with features in f."""
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    proposed = packed.select("row", F.concat(*[_found(text, k) for k in range(len(KINDS))]).alias("found"))
    checked = proposed.withColumn("found", F.transform("found", lambda c: F.struct(c.alias("c"), _valid(c).alias("valid"))))
    base = F.transform(F.filter("found", lambda x: x["valid"]), lambda x: F.struct(x["c"]["start"].alias("start"), x["c"]["kind"].alias("kind"), x["c"]["end"].alias("end")))
    rest = F.transform(F.filter("found", lambda x: ~x["valid"]), lambda x: F.struct(x["c"]["start"].alias("start"), x["c"]["kind"].alias("kind"), x["c"]["end"].alias("end"), _features(x["c"]).alias("f")))
    return checked.withColumn("base", F.array_sort(base)).withColumn("others", rest).drop("found")


def examples() -> list[tuple[str, int]]:
    """Labelled texts with one candidate each, from templates."""
    rng = random.Random(SEED)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 8)))

    def luhn(n: int) -> str:
        body = [int(x) for x in "4" + d(n - 2)]
        total = sum(x if k % 2 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(body)))
        return "".join(map(str, body)) + str(-total % 10)

    def spaced(n: str) -> str:
        return rng.choice(["", " ", "-"]).join(n[k : k + 4] for k in range(0, len(n), 4))

    real: list[Callable[[], str]] = [
        lambda: f"{rng.choice(['call', 'tel:', 'Phone', 'fax', 'mobile:', 'reach me at'])} ({d(3)}) {d(3)}-{d(4)}",
        lambda: f"{rng.choice(['call', 'tel', 'cell:', 'phone'])} {d(3)}{(s := rng.choice('.- '))}{d(3)}{s}{d(4)}",
        lambda: f"{w()} ({d(3)}) {d(3)}-{d(4)} {w()}",
        lambda: f"{rng.choice(['SSN', 'social', 'tax id', 'passport no.'])} {d(3)}-{d(2)}-{d(4)}",
        lambda: f"{rng.choice(['mail', 'contact', 'write to', w()])} {w()}.{w()} {rng.choice(['(at)', '[at]'])} {w()} {rng.choice(['(dot)', '[dot]'])} com",
        lambda: f"{w()} {rng.choice(['password', 'token', 'api_key', 'secret'])}{rng.choice(['=', ': ', ' = '])}{rng.choice(['', chr(34)])}{''.join(rng.choice('0123456789abcdef') for _ in range(rng.randint(12, 40)))}",
        lambda: f"{w()} AKIA{''.join(rng.choice('ABCDEFGHJKLMNPQRSTUVWXYZ234567') for _ in range(16))} {w()}",
        lambda: f"{rng.choice(['card', 'visa', 'account number'])} {spaced(d(16))}",
        lambda: f"{w()} {d(16)}{rng.choice(['', '.', ',', '!!'])} {w()}",  # a run of sixteen figures in prose: an account, if not a card
        lambda: f"{rng.choice(['call', 'dial', 'tel'])} +{d(2)} {d(2)} {d(3)}",
    ]
    other: list[Callable[[], str]] = [
        lambda: f"{rng.choice(['order', 'invoice', 'isbn', 'item', 'sku'])} {rng.choice(['no.', 'number', ''])} {spaced(d(16))}",
        lambda: f"{w()} {spaced(d(rng.choice([12, 13, 14, 18, 20])))} {w()}",
        lambda: f"{rng.choice(['version', 'release', 'section', w()])} {rng.randint(256, 999)}.{d(2)}.{d(2)}.{d(1)}",
        lambda: f"{rng.choice(['date', 'since', w(), w()])} {rng.randint(10, 31)}{(s := rng.choice('./-'))}{rng.randint(10, 12)}{s}{rng.randint(1900, 2030)}",
        lambda: f"{rng.choice(['date', w()])} {rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 31)}",
        lambda: f"{w()} {d(2)} {d(3)} {d(3)} {rng.choice(['kg', 'km', 'pages', w(), w()])}",
        lambda: f"total {rng.choice('$€')}{d(3)} {d(3)} {d(3)}",
        lambda: f"{w()} {d(3)} {d(2)} {d(2)} {d(4)} {w()}",
        lambda: f"{w()} +{d(1)} {d(2)}",
        lambda: f"{rng.choice(['isbn', 'order'])} {d(3)}-{d(2)}-{d(4)}",
    ]
    return [((real if k % 2 == 0 else other)[k // 2 % len(real if k % 2 == 0 else other)](), 1 - k % 2) for k in range(EXAMPLES)]


Tree = tuple


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Tree:
    """A regression tree on gradients: (feature, threshold, left, right) or (value,)."""
    leaf = (float(g.sum() / (h.sum() + 1.0)),)
    if depth == 0 or len(g) < 20:
        return leaf
    gain = lambda a: g[a].sum() ** 2 / (h[a].sum() + 1.0)
    best = (1e-6, None, None)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for j in range(x.shape[1]):
        for t in np.unique(x[:, j])[:-1]:
            low = x[:, j] <= t
            if (now := gain(low) + gain(~low) - whole) > best[0]:
                best = (now, j, int(t))
    if best[1] is None:
        return leaf
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def _value(tree: Tree, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    low = x[:, tree[0]] <= tree[1]
    return np.where(low, _value(tree[2], x), _value(tree[3], x))


def boost(x: np.ndarray, y: np.ndarray) -> list[Tree]:
    score, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, y - p, p * (1 - p), 3)
        trees.append(tree)
        score += RATE * _value(tree, x)
    return trees


def calibrate(score: np.ndarray, y: np.ndarray, kind: np.ndarray) -> list[float]:
    """For each kind the lowest score above which PRECISION of the kept examples are real; infinite if there is none."""
    out = []
    for k in range(len(KINDS)):
        s, t = score[kind == k], y[kind == k]
        fits = [c for c in np.unique(s) if t[s >= c].mean() >= PRECISION and t[s >= c].sum() >= 5]
        out.append(float(min(fits)) if fits else float("inf"))
    return out


_fitted: tuple[list[Tree], list[float]] | None = None


def model(spark: SparkSession) -> tuple[list[Tree], list[float]]:
    """The fitted trees and thresholds; the examples are always the same, so a process fits them once."""
    global _fitted
    if _fitted is None:
        _fitted = train(spark)
    return _fitted


def train(spark: SparkSession) -> tuple[list[Tree], list[float]]:
    """Trees and thresholds by kind."""
    made = examples()
    told = ",".join(f"({k}, '{t.replace(chr(39), chr(39) * 2)}', {y})" for k, (t, y) in enumerate(made))
    seen = candidates(spark.sql(f"SELECT * FROM VALUES {told} AS v(n, text, label)")).select("row.n", "row.label", F.explode("others").alias("o")).select("n", "label", "o.f.*").orderBy("n", *FEATURES).collect()
    x, y = np.array([[r[k] for k in FEATURES] for r in seen], int), np.array([r["label"] for r in seen], float)
    held = np.array([r["n"] * 7919 % 1009 % 3 == 0 for r in seen])
    trees = boost(x[~held], y[~held])
    return trees, calibrate(RATE * sum(_value(t, x[held]) for t in trees), y[held], x[held][:, 0])


def score_sql(trees: list[Tree], f: str) -> str:
    """The boosted score as SQL over the fields of ``f``."""

    def as_case(tree: Tree) -> str:
        if len(tree) == 1:
            return f"{tree[0] * RATE!r}D"
        return f"CASE WHEN {f}.{FEATURES[tree[0]]} <= {tree[1]} THEN {as_case(tree[2])} ELSE {as_case(tree[3])} END"

    return " + ".join(map(as_case, trees))


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with base and spans: arrays of (start, kind, end), kinds by their number in KINDS."""
    trees, least = model(docs.sparkSession)
    levels = F.array(*[F.lit(min(t, 1e9)) for t in least])
    span = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    beats = lambda o, c: meets(o, c) & ((o["score"] > c["score"]) | ((o["score"] == c["score"]) & ((o["start"] < c["start"]) | ((o["start"] == c["start"]) & (o["kind"] < c["kind"])))))

    def select(v: Column) -> Column:
        sure = F.filter(v["scored"], lambda c: c["score"] >= F.element_at(levels, c["kind"] + 1))
        clear = F.filter(sure, lambda c: ~F.exists(v["base"], lambda b: meets(b, c)))
        best = _let(clear, lambda s: F.filter(s, lambda c: ~F.exists(s, lambda o: beats(o, c))))
        return F.array_sort(F.concat(v["base"], F.transform(best, span)))

    scored = F.expr(f"transform(others, c -> struct(c.start AS start, c.kind AS kind, c.`end` AS `end`, {score_sql(trees, 'c.f')} AS score))")
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("base", "spans")]
    return candidates(docs).select(*kept, "base", _let(F.struct("base", scored.alias("scored")), select).alias("spans"))


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with ``redacted``: the text with every span replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
        F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1)).alias("out"))
    )
    whole = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.char_length("text"))))
    return find(docs).withColumn("redacted", whole)
