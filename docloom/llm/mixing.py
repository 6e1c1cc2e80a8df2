"""Soft-membership mixing: predicted domain posteriors, and document rates whose expected domain totals match targets."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import private, settled

BUCKETS = 16384  # hashed word beginnings, and as many hashed word endings, that the classifier knows
SURE = 6.0  # standard errors by which a bucket's document frequency in a domain must differ from the first's to count
CLEAR = 1.0  # and the log odds it must have, as weak ones of many dependent buckets add up to false certainty
LABELLED = 20_000  # labelled rows that training reads at most
SHARPNESS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5)
RIDGE = 0.02  # keeps the weight of a domain's miss bounded where posteriors hardly tell it apart
ROUNDS = 60
TOLERANCE = 1e-4  # of all tokens, by which a domain's expected total may miss its target
CELLS = 50  # steps of a posterior in the summary by which the scale of the targets is chosen
GROWTH = tuple(1.1**k for k in range(16))  # of that scale over the least one at which no domain has to shrink
REACHED = 1e-3  # of the scale, by which a domain's total may miss its target there
EVERY = 8  # rounds between checkpoints of the rates


def number_array(values: tuple[float, ...]) -> Column:
    """A constant array; as one folded literal it costs the plan one node."""
    return F.split(F.lit(",".join(f"{x:.6g}" for x in values)), ",").cast("array<double>")


def word_list(text_col: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "[ \n]"), lambda w: w != "")


def features(words: Column) -> Column:
    """The distinct buckets of a document's words: beginnings of four characters, then endings of three."""
    hashed = lambda part, at: (F.pmod(F.xxhash64(part), F.lit(BUCKETS)) + at).cast("int")
    heads = F.transform(words, lambda w: hashed(F.left(w, F.lit(4)), 0))
    return F.array_distinct(F.concat(heads, F.transform(words, lambda w: hashed(F.right(w, F.lit(3)), BUCKETS))))


@dataclass(frozen=True)
class Classifier:
    """Naive Bayes over the buckets that documents hold: log odds of each domain against the first, sharpened."""

    domains: tuple[str, ...]
    prior: tuple[float, ...]
    odds: tuple[tuple[float, ...], ...] = field(repr=False, default=())
    absent: tuple[float, ...] = ()
    sharp: float = 1.0

    def sums(self, found: Column) -> list[Column]:
        """Log odds of each domain but the first, for the buckets that a document holds and those it lacks."""
        add = lambda table: lambda s, b: s + F.get(table, b)
        return [F.aggregate(found, F.lit(a), add(number_array(t))) for t, a in zip(self.odds, self.absent, strict=True)]

    def posterior(self, sums: list[Column], sharp: float | None = None) -> list[Column]:
        sharp = self.sharp if sharp is None else sharp
        raw = [F.lit(math.log(self.prior[0])), *(F.lit(math.log(p)) + F.lit(sharp) * m for p, m in zip(self.prior[1:], sums, strict=True))]
        top = F.greatest(*raw) if len(raw) > 1 else raw[0]
        grown = [F.exp(x - top) for x in raw]
        return [x / sum(grown[1:], grown[0]) for x in grown]


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", rows: int = LABELLED) -> Classifier:
    """From the first ``rows`` labelled ids in hash order. Ids and domains that are null or not asked for don't count.

    The sample of (id, domain) is bounded and broadcast; texts are read where they lie and only counts by (bucket,
    domain) come to the driver. Without any labelled text all documents get the uniform posterior.
    """
    named = labelled.where(F.col(domain_col).isin(domains) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(domain_col).alias("_domain"))
    few = settled(named.orderBy(F.xxhash64("_id"), "_id").limit(rows))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(few), "_id").select("_domain", features(word_list("_text")).alias("_found"))
    texts = settled(texts)
    seen = texts.select("_domain", F.explode("_found").alias("b")).groupBy("_domain", "b").agg(F.count("*").alias("n")).collect()
    count = dict(texts.groupBy("_domain").count().collect())
    n = np.array([count.get(d, 0) for d in domains], dtype=float)
    prior = tuple(((n + 1) / (n.sum() + len(domains))).tolist())
    table = np.zeros((len(domains), 2 * BUCKETS))
    for d, b, k in seen:
        table[domains.index(d), b] = k
    share = (table + 0.5) / (n[:, None] + 1)
    both = (table[0] + table[1:] + 1) / (n[0] + n[1:, None] + 2)
    error = np.sqrt(both * (1 - both) * (1 / (n[0] + 1) + 1 / (n[1:, None] + 1)))
    odds = np.log(share[1:]) - np.log(share[0])
    counts = (np.abs(share[1:] - share[0]) >= SURE * error) & (np.abs(odds) >= CLEAR)
    none = np.where(counts, np.log1p(-share[1:]) - np.log1p(-share[0]), 0.0)
    model = Classifier(tuple(domains), prior, tuple(map(tuple, np.where(counts, odds - none, 0.0).tolist())), tuple(none.sum(axis=1).tolist()))
    if len(domains) == 1 or not seen:
        return model
    held = settled(texts.select("_domain", *(m.alias(f"m{k}") for k, m in enumerate(model.sums(F.col("_found"))))))
    sums = [F.col(f"m{k}") for k in range(len(domains) - 1)]

    def loss(sharp: float) -> Column:
        right = F.coalesce(*(F.when(F.col("_domain") == d, p) for d, p in zip(domains, model.posterior(sums, sharp), strict=True)))
        return F.avg(-F.log(F.greatest(right, F.lit(1e-12))))

    losses = held.agg(*(loss(s).alias(f"s{k}") for k, s in enumerate(SHARPNESS))).first()
    return Classifier(model.domains, prior, model.odds, model.absent, min(zip(losses, SHARPNESS, strict=True))[1])


def stepped(rate: Column, ahead: Column, posterior: list[Column], steps: list[tuple[list[float], float]], least: float = 0.0) -> Column:
    """(rate, ahead) after projected-gradient steps: rate = max(least, ahead - posterior . gap), ahead = rate plus momentum."""
    start = F.struct(rate.cast("double").alias("r"), ahead.cast("double").alias("y"))
    if not steps:
        return start
    moves = F.array(*(F.struct(*(F.lit(float(x)).alias(f"e{k}") for k, x in enumerate(gap)), F.lit(float(beta)).alias("b")) for gap, beta in steps))

    def step(s: Column, m: Column) -> Column:
        new = F.greatest(F.lit(least), s["y"] - sum((p * m[f"e{k}"] for k, p in enumerate(posterior)), F.lit(0.0)))
        return F.struct(new.alias("r"), (new + m["b"] * (new - s["r"])).alias("y"))

    return F.aggregate(moves, start, step)


def fitted_totals(n: np.ndarray, p: np.ndarray, whiten: np.ndarray, targets: np.ndarray, rounds: int) -> np.ndarray:
    """The totals by domain that fit_rates() comes to with rates of 1 at least, for shares ``n`` of the tokens at posteriors ``p``."""
    rate, ahead, moment = np.ones(len(n)), np.ones(len(n)), 1.0
    for _ in range(rounds):
        grown = (1 + math.sqrt(1 + 4 * moment * moment)) / 2
        new = np.maximum(1.0, ahead - p @ (whiten @ ((n * ahead) @ p - targets)))
        rate, ahead, moment = new, new + (moment - 1) / grown * (new - rate), grown
    return (n * rate) @ p


def reachable_scale(soft: DataFrame, whiten: np.ndarray, share: np.ndarray, now: np.ndarray, rounds: int) -> float:
    """The least scale of GROWTH at which rates of 1 at least meet the targets; else the one with the nearest shares.

    Rates depend on posteriors alone, so a summary by rounded posteriors, whose size doesn't grow with the corpus, will do.
    """
    domains = len(share)
    p = [F.col(f"p{k}") for k in range(domains)]
    cells = soft.groupBy(*(F.round(x * CELLS).alias(f"c{k}") for k, x in enumerate(p[1:]))).agg(F.sum("n"), *(F.sum(F.col("n") * x) for x in p)).collect()
    table = np.array([[float(x or 0) for x in r[domains - 1 :]] for r in cells])
    table = table[table[:, 0] > 0]
    n, p = table[:, 0] / table[:, 0].sum(), table[:, 1:] / table[:, :1]
    first = max([1.0, *(now / np.where(share > 0, share, np.inf))])
    misses = []
    for scale in (first * g for g in GROWTH):
        got = fitted_totals(n, p, whiten, scale * share, rounds)
        if np.abs(got - scale * share).max() <= REACHED * scale:
            return scale
        misses.append((np.abs(got / got.sum() - share).max(), scale))
    return min(misses)[1]


def fit_rates(soft: DataFrame, domains: int, weights: list[float], keep_all: bool = False, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> list[tuple[list[float], float]]:
    """The steps that lead from rate 1 to nonnegative rates, or rates of 1 at least with ``keep_all``, with expected domain totals at their targets.

    ``soft``: n (tokens), p0, p1, ... of every document. Least squares over totals by accelerated projected gradient;
    the misses are weighted by the inverse of the domains' second moments (plus a ridge), so that domains that posteriors
    hardly tell apart converge about as fast as others. Targets out of reach get the nearest totals. Each round is one aggregate of ``domains`` sums over all documents, and since a rate depends on the posterior and
    the sums alone, the steps describe the rates of all documents. Targets share out the present tokens by ``weights``;
    ``keep_all`` raises them together until rates of 1 at least meet them.
    """
    p = [F.col(f"p{k}") for k in range(domains)]
    first = soft.agg(F.sum("n"), *(F.sum(F.col("n") * x) for x in p), *(F.sum(F.col("n") * x * y) for x in p for y in p)).first()
    total = float(first[0] or 0)
    if not total:
        return []
    moments = np.array(first[1 + domains :], dtype=float).reshape(domains, domains) / total
    whiten = np.linalg.inv(moments + RIDGE * np.eye(domains))
    before = np.full(domains, np.inf)
    share = [w / sum(weights) for w in weights]
    held = np.array(first[1 : 1 + domains], dtype=float) / total
    scale = reachable_scale(soft, whiten, np.array(share), held, rounds) if keep_all else 1.0
    least = 1.0 if keep_all else 0.0
    now = settled(soft.select("n", *p, F.lit(1.0).alias("r"), F.lit(1.0).alias("y")))
    steps: list[tuple[list[float], float]] = []
    done, moment = 0, 1.0
    for _ in range(rounds):
        s = now.select("n", *p, stepped(F.col("r"), F.col("y"), p, steps[done:], least).alias("s"))
        sums = s.agg(*(F.sum(F.col("n") * F.col("s.y") * x) for x in p), *(F.sum(F.col("n") * F.col("s.r") * x) for x in p)).first()
        gaps = [float(a) / total - scale * w for a, w in zip(sums, [*share, *share], strict=True)]
        if max(map(abs, gaps[domains:])) <= tolerance or np.abs(before - gaps[domains:]).max() <= tolerance / 10:
            break
        before = np.array(gaps[domains:])
        grown = (1 + math.sqrt(1 + 4 * moment * moment)) / 2
        steps.append(((whiten @ gaps[:domains]).tolist(), (moment - 1) / grown))
        moment = grown
        if len(steps) - done == EVERY:
            s = now.select("n", *p, stepped(F.col("r"), F.col("y"), p, steps[done:], least).alias("s"))
            now, done = settled(s.select("n", *p, F.col("s.r").alias("r"), F.col("s.y").alias("y"))), len(steps)
    return steps


def chance(id_col: str, text_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def with_posteriors(rows: DataFrame, model: Classifier, words: str, names: list[str]) -> DataFrame:
    """Posterior columns for a column of words, which goes; the sums are a column first, so that each is computed once."""
    (held,) = private(rows, "sums")
    rows = rows.withColumn(held, F.array(*model.sums(features(F.col(words))), F.lit(0.0))).drop(words)
    sums = [F.get(held, F.lit(k)) for k in range(len(names) - 1)]
    return rows.withColumns(dict(zip(names, model.posterior(sums), strict=True))).drop(held)


def rounded(rate: Column, draw: Column) -> Column:
    return F.floor(rate + draw).cast("int")


def rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", keep_all: bool = False) -> DataFrame:
    """(id, tokens, p_<domain>..., rate, copies) of each row, as mix() has them, from one pass over the texts."""
    domains = list(weights)
    model = fit_classifier(docs, labelled, domains, id_col, text_col, domain_col)
    names = [f"p{k}" for k in range(len(domains))]
    rows = docs.select(F.col(id_col).alias("_id"), chance(id_col, text_col).alias("_draw"), word_list(text_col).alias("_words")).withColumn("n", F.size("_words").cast("long"))
    soft = settled(with_posteriors(rows, model, "_words", names))
    steps = fit_rates(soft, len(domains), list(weights.values()), keep_all)
    rate = stepped(F.lit(1.0), F.lit(1.0), [F.col(x) for x in names], steps, 1.0 if keep_all else 0.0)["r"]
    out = soft.withColumn("rate", rate)
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("tokens"), *(F.col(x).alias(f"p_{d}") for x, d in zip(names, domains, strict=True)), "rate", rounded(F.col("rate"), F.col("_draw")).alias("copies"))


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", keep_all: bool = False) -> DataFrame:
    """The documents with columns tokens, p_<domain>..., rate and copies; replaced where docs has such names.

    copies is the rate rounded down or up by a hash of id and text, so that copies are rates on average; with
    ``keep_all`` rates, and so copies, are 1 at least. Tokens are words between spaces and line feeds. Null or empty texts have no tokens,
    the posterior of a text without known words, and rates like any other; repeated rows get equal rates and copies;
    null ids take part. No rows give no rows. Posteriors are computed twice, once for the fit and once for the result,
    so that no text is shuffled; where the texts aren't wanted, rates() reads them once.
    """
    domains = list(weights)
    model = fit_classifier(docs, labelled, domains, id_col, text_col, domain_col)
    names = [f"p{k}" for k in range(len(domains))]
    words = docs.select(word_list(text_col).alias("_words")).withColumn("n", F.size("_words").cast("long"))
    steps = fit_rates(settled(with_posteriors(words, model, "_words", names)), len(domains), list(weights.values()), keep_all)
    (words,) = private(docs, "words")
    out = docs.withColumn(words, word_list(text_col)).withColumn("tokens", F.size(words).cast("long"))
    out = with_posteriors(out, model, words, [f"p_{d}" for d in domains])
    out = out.withColumn("rate", stepped(F.lit(1.0), F.lit(1.0), [F.col(f"p_{d}") for d in domains], steps, 1.0 if keep_all else 0.0)["r"])
    return out.withColumn("copies", rounded(F.col("rate"), chance(id_col, text_col)))


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from a table of quality and toxic marks: toxic, poor or good; rows without marks have none."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))
