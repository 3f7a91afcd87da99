"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good, votes bad or abstains. Expectation-maximisation over the counts of vote patterns (3 ** rules rows at
most, whatever the corpus) estimates how often each rule votes what on good and on bad documents; a document is kept if
its posterior probability of being good reaches KEEP.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

SPACES = r"[\x20\x09-\x0D]+"
BAD, ABSTAIN, GOOD = 0, 1, 2
MIN_WORDS, MAX_REPEAT = 50, 50
KEEP, ROUNDS = 0.5, 50
#: Where EM starts: how likely a vote (bad, abstain, good) is on documents bad in the rule's own way, on good ones, and
#: on those bad in another way; the share of good documents; and the weight of these guesses, as a share of all documents.
OWN, ON_GOOD, ON_OTHERS = (0.9, 0.07, 0.03), (0.005, 0.145, 0.85), (0.1, 0.15, 0.75)
GOOD_SHARE, TRUST = 0.8, 0.02


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_lines, n_upper, n_distinct."""
    text = F.coalesce("text", F.lit(""))
    got = docs.withColumn("_w", F.array_remove(F.split(text, SPACES, -1), "")).withColumn("_l", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    got = got.withColumn("n_words", F.size("_w").cast("long")).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    at = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.col("n_words").cast("int") - 3)).otherwise(F.array().cast("array<int>"))
    got = got.withColumn("_g", F.transform(at, lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2))))
    some = F.size(F.array_distinct("_g")) < F.size("_g")
    got = got.withColumn("_s", F.when(some, F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(F.array().cast("array<struct<g: bigint, i: int>>")))
    equal = lambda x, k: F.coalesce(F.get("_s", k)["g"] == x["g"], F.lit(False))
    got = got.withColumn("_r", F.array_sort(F.transform(F.filter("_s", lambda x, k: equal(x, k - 1) | equal(x, k + 1)), lambda x: x["i"])))
    fresh = F.transform("_r", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_r", k + 1) - p, F.lit(3))))
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    got = got.withColumns({
        "word_chars": add(F.transform("_w", lambda w: F.char_length(w))),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": add(fresh),
        "n_lines": F.size("_l").cast("long"),
        "n_upper": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
        "n_distinct": F.size(F.array_distinct("_w")).cast("long"),
    })
    return got.drop("_w", "_l", "_h", "_g", "_s", "_r")


def rules() -> dict[str, tuple[Column, Column]]:
    """(when a rule votes bad, when it votes good) by name; else it abstains, as all do on a document without words."""
    n, c = F.col("n_words"), F.col
    share = lambda x, of, percent: 100 * c(x) > percent * of
    return {
        "repeats": (share("n_repeat_words", n, 40), ~share("n_repeat_words", n, 15)),
        "symbols": (share("n_symbols", n, 30), ~share("n_symbols", n, 5)),
        "lines": ((c("n_dup_lines") > 2) & share("n_dup_lines", c("n_lines"), 30), (c("n_dup_lines") == 0) & (c("n_lines") > 1)),
        "capitals": (share("n_upper", c("word_chars"), 20), ~share("n_upper", c("word_chars"), 8)),
        "length": ((c("word_chars") > 9 * n) | (c("word_chars") < 3 * n), (c("word_chars") >= 4 * n) & (c("word_chars") <= 7 * n)),
        "variety": (100 * c("n_distinct") < 25 * n, 100 * c("n_distinct") >= 45 * n),
    }


def expectation_maximisation(counts: dict[int, int], n_rules: int, kinds: tuple[int, ...], rounds: int = ROUNDS) -> tuple[dict[int, float], float]:
    """The probability that a document is good, for each vote pattern (base 3, the first rule lowest), and the log likelihood.

    A document is good, or bad in a way that one rule of `kinds` is about: bad documents of different kinds agree on
    little, so each kind has vote rates of its own. rates[kind][rule][vote]; kind 0 is good, kind k what rule kinds[k - 1] looks for.
    """
    votes = {p: [p // 3**r % 3 for r in range(n_rules)] for p in counts}
    n, total = len(kinds) + 1, sum(counts.values())
    start = [[list(ON_GOOD) for _ in range(n_rules)]] + [[list(OWN if k == r else ON_OTHERS) for r in range(n_rules)] for k in kinds]
    rates, prior = [[list(x) for x in k] for k in start], [GOOD_SHARE] + [(1 - GOOD_SHARE) / max(1, len(kinds))] * len(kinds)
    post: dict[int, list[float]] = {}
    likelihood = 0.0
    for step in range(rounds):
        logs = [[[math.log(x) for x in r] for r in k] for k in rates]
        shares = [math.log(x) for x in prior]
        likelihood = 0.0
        for p, v in votes.items():
            each = [shares[k] + sum(logs[k][r][x] for r, x in enumerate(v)) for k in range(n)]
            most = max(each)
            each = [math.exp(x - most) for x in each]
            post[p] = [x / sum(each) for x in each]
            likelihood += counts[p] * (most + math.log(sum(each)))
        if step == rounds - 1 or not total:
            break
        held = TRUST * total
        for k in range(n):
            sure = {p: counts[p] * post[p][k] for p in counts}
            mass = sum(sure.values())
            prior[k] = (mass + 1) / (total + n)
            for r in range(n_rules):
                got = [0.0, 0.0, 0.0]
                for p, v in votes.items():
                    got[v[r]] += sure[p]
                rates[k][r] = [(got[x] + held * start[k][r][x]) / (mass + held) for x in range(3)]
    return {p: x[0] for p, x in post.items()}, likelihood


def posterior(counts: dict[int, int], n_rules: int) -> tuple[dict[int, float], tuple[int, ...]]:
    """The probability of good for each vote pattern, and the rules whose bad votes mark a kind of bad documents.

    A rule has a kind of its own only if that explains the votes better than errors of the rule on good documents do, by
    the Bayesian information criterion: its bad votes must go with other votes of other rules. So a rule that votes bad
    at random, however often, rejects nothing by itself. Kinds are dropped one by one, the least useful first.
    """
    total, kinds = sum(counts.values()), tuple(range(n_rules))
    score = lambda ks: (lambda post, fit: (fit - (1 + 2 * n_rules) * len(ks) * math.log(max(2, total)) / 2, post))(*expectation_maximisation(counts, n_rules, ks))
    best, post = score(kinds)
    while kinds:
        fewer = max(((*score(ks), ks) for ks in (tuple(x for x in kinds if x != k) for k in kinds)), key=lambda x: x[0])
        if fewer[0] < best:
            break
        best, post, kinds = fewer
    return post, kinds


def judge(docs: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """docs (less the columns in `without`) with the measures, the votes, base_failed, p_good and kept.

    Base rules reject documents of fewer than MIN_WORDS words, or with more than MAX_REPEAT percent of them in repeated
    3-word windows; a null text has no words. Repeated rows and null ids are judged as they stand, each by itself, and
    very long texts as a whole, in one row. Without evidence (in a small table, say) the posterior keeps a document; an
    empty table stays empty. Columns of docs that are named like a measure, a vote or a verdict are replaced: a caller
    that needs them puts its row into a struct first.
    """
    got = measured(docs.drop("n_words", "p_good", "kept", "base_failed"))
    named = rules()
    vote = {f"vote_{k}": F.when(F.col("n_words") == 0, ABSTAIN).when(b, BAD).when(g, GOOD).otherwise(ABSTAIN) for k, (b, g) in named.items()}
    got = got.withColumns(vote)
    pattern = sum((F.col(k) * 3**r for r, k in enumerate(vote)), F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    got = settle(got.withColumns({"pattern": pattern.cast("int"), "base_failed": failed}).drop(*without))
    counts = {r["pattern"]: r["count"] for r in got.groupBy("pattern").count().collect()}  # 3 ** rules rows at most
    post, _ = posterior(counts, len(named))
    table_ = F.array(*[F.lit(float(post.get(p, 0.5))) for p in range(3 ** len(named))])
    p_good = F.get(table_, F.col("pattern"))
    return got.withColumn("p_good", p_good).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP)).drop("pattern")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their base measures and the verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, without=("text",)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 9).alias("p_good"))


def quality_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_quality that don't depend on the vote, which SQL can give."""
    return op3_quality(spark, sf_dir).drop("kept", "p_good")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g SEMI JOIN twice USING (doc_id, g)) GROUP BY doc_id),
m AS (SELECT doc_id, t, ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, coalesce(n, 0) AS n FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n::BIGINT AS n_repeat_words, len(ws) < 50 OR 100 * n > 50 * len(ws) AS base_failed FROM m
"""
