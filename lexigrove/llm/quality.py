"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule votes good (1), bad (0) or abstains (null). Rows are counted by vote pattern, expectation-maximisation
over those counts (at most 3**rules of them, whatever the corpus holds) estimates how often a rule is right, and a text's posterior probability of being good decides. Two base rules reject outright.

Null and empty texts have no words: ``n_words`` 0, base rule failed, not kept. Repeated rows and ids are judged
row by row. An empty table gives an empty result. Other columns pass through untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import staged

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
EM_STEPS = 25
#: A rule's accuracy before any data, the weight of that as a share of all rows, and its bounds: better than chance.
PRIOR_RIGHT, PRIOR_SHARE = 0.85, 0.01
LEAST_RIGHT, MOST_RIGHT = 0.55, 0.99
HELD = "__quality"


def _bad(when: Column) -> Column:
    return F.when(when, F.lit(0))


#: name -> vote from the measures in struct ``m``: 0 bad, 1 good, null abstains. A text can be bad in one way alone,
#: so most rules look for one defect and abstain without it, and only marks of plain prose speak for a text.
RULES = {
    "symbols": lambda m: _bad(m.n_symbols * 5 > m.n_words),
    "capitals": lambda m: _bad(m.n_upper * 2 > m.n_letters),
    "shouting": lambda m: _bad(m.n_shouts * 5 > m.n_words),
    "repeats": lambda m: _bad(m.n_repeat_words * 100 > MAX_REPEAT_PERCENT * m.n_words),
    "lines": lambda m: _bad(m.n_dup_lines * 10 > 3 * m.n_lines),
    "word_length": lambda m: _bad((m.word_chars < 2 * m.n_words) | (m.word_chars > 16 * m.n_words)),
    "length": lambda m: _bad(m.n_words < MIN_WORDS),
    "plain": lambda m: F.when((m.n_words >= MIN_WORDS) & (m.n_symbols * 10 <= m.n_words) & (m.n_shouts * 20 <= m.n_words) & (m.n_upper * 4 <= m.n_letters), 1),
    "fresh_lines": lambda m: F.when((m.n_lines >= 3) & (m.n_dup_lines * 10 <= m.n_lines) & (m.n_symbols * 10 <= m.n_words), 1),
}


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``__quality`` of counts. All of it runs in the row, without a shuffle."""
    d = docs.withColumn(HELD, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    d = d.withColumn(
        HELD,
        F.struct(
            F.array_remove(F.split(HELD, SPACE), "").alias("w"),
            F.filter(F.split(HELD, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
            F.regexp_count(HELD, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.regexp_count(HELD, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count(HELD, F.lit(r"\p{L}")).cast("long").alias("n_letters"),
            F.regexp_count(HELD, F.lit(r"!!")).cast("long").alias("n_shouts"),
        ),
    )
    kept = ("n_symbols", "n_upper", "n_letters", "n_shouts")
    held = lambda *more: F.struct(*(F.col(f"{HELD}.{k}") for k in kept), *more)
    size = lambda c: F.size(c).cast("long")
    d = d.withColumn(
        HELD,
        held(
            size(f"{HELD}.w").alias("n_words"),
            F.length(F.array_join(f"{HELD}.w", "")).cast("long").alias("word_chars"),
            size(f"{HELD}.lines").alias("n_lines"),
            (size(f"{HELD}.lines") - size(F.array_distinct(f"{HELD}.lines"))).alias("n_dup_lines"),
            F.transform(f"{HELD}.w", lambda x: F.xxhash64(x)).alias("h"),
        ),
    )
    kept += ("n_words", "word_chars", "n_lines", "n_dup_lines")
    # Hashes of the five-word windows; texts in which all differ are done.
    h = F.col(f"{HELD}.h")
    windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
    d = d.withColumn(HELD, held(F.when(F.size(h) > WINDOW, windows).alias("win")))
    win = F.col(f"{HELD}.win")
    pairs = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.withColumn(HELD, held(F.when(F.size(F.array_distinct(win)) < F.size(win), pairs).alias("s")))
    s = F.col(f"{HELD}.s")
    twice = F.transform(s, lambda e, k: F.when((e.x == F.get(s, k - 1).x) | (e.x == F.get(s, k + 1).x), e.i))
    d = d.withColumn(HELD, held(F.when(s.isNotNull(), F.sort_array(F.array_compact(twice))).alias("p")))
    p = F.col(f"{HELD}.p")
    # Starts in order: each covers up to the next start, five words at most.
    cover = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    d = d.withColumn(HELD, held(F.coalesce(F.when(p.isNotNull(), cover), F.lit(0)).cast("long").alias("n_repeat_words")))
    m = F.col(HELD)
    failed = (m.n_words < MIN_WORDS) | (m.n_repeat_words * 100 > m.n_words * MAX_REPEAT_PERCENT)
    votes = F.struct(*(f(m).alias(k) for k, f in RULES.items()))
    return d.withColumn(HELD, F.struct(*(m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed.alias("base_failed"), votes.alias("votes")))


def fit(measured: DataFrame) -> dict[str, tuple[float, float]]:
    """rule -> (accuracy of its bad votes, accuracy of its good votes), by expectation-maximisation.

    Classes are equally likely before any vote, rules independent given the class, and abstaining says nothing.
    Only counts of vote patterns reach the driver: 3**len(RULES) rows at most.
    """
    names = list(RULES)
    rows = measured.groupBy(*(F.col(f"{HELD}.votes.{k}").alias(k) for k in names)).count().collect()
    patterns = sorted((tuple(-1 if r[k] is None else r[k] for k in names), r["count"]) for r in rows)
    prior = PRIOR_SHARE * max(1, sum(c for _, c in patterns))
    right = {k: [PRIOR_RIGHT, PRIOR_RIGHT] for k in names}
    for _ in range(EM_STEPS):
        hits = {k: [PRIOR_RIGHT * prior, PRIOR_RIGHT * prior] for k in names}
        seen = {k: [prior, prior] for k in names}
        for pattern, count in patterns:
            cast = [(k, v) for k, v in zip(names, pattern, strict=True) if v >= 0]
            odds = sum((1 if v else -1) * math.log(right[k][v] / (1 - right[k][v])) for k, v in cast)
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
            for k, v in cast:
                hits[k][v] += count * (p if v else 1 - p)
                seen[k][v] += count
        right = {k: [min(MOST_RIGHT, max(LEAST_RIGHT, a / n)) for a, n in zip(hits[k], seen[k], strict=True)] for k in names}
    return {k: tuple(x) for k, x in right.items()}


def posterior(right: dict[str, tuple[float, float]]) -> Column:
    """P(good | votes) as a column."""
    odds = F.lit(0.0)
    for k, (bad, good) in right.items():
        v = F.col(f"{HELD}.votes.{k}")
        odds = odds + F.when(v == 0, F.lit(-math.log(bad / (1 - bad)))).when(v == 1, F.lit(math.log(good / (1 - good)))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (default all) and ``__quality``: counts, base_failed, probability, kept.

    The measured rows are staged once, so texts are read and split once for both the fit and the verdicts.
    """
    cols = docs.columns if carry is None else carry
    measured = staged(with_measures(docs, text).select(*(F.col(f"`{c}`") for c in cols), HELD), "quality")
    p = posterior(fit(measured))
    m = F.col(HELD)
    return measured.withColumn(HELD, m.withField("probability", p)).withColumn(HELD, m.withField("kept", ~m.base_failed & (m.probability >= 0.5)))


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that are rejected."""
    own = [f"__own{k}" for k in range(len(docs.columns))]
    inner = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own, strict=True)))
    kept = judge(inner, own[docs.columns.index(text)]).filter(F.col(f"{HELD}.kept"))
    return kept.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, own, strict=True)))
