"""Mixing to target weights by soft membership, in DataFrame functions only.

1. A labelled table (doc_id, domain) teaches a multinomial naive Bayes classifier over hashed words, from at most PER_CLASS
   documents of each domain; its log-likelihoods (BUCKETS rows at most: that bounds the broadcast) give every document evidence
   for each domain, tempered for length, which a small softmax, fitted on labels held back, turns into a posterior.
2. Every document gets a rate in 0..max_rate. Expected domain totals T_k = sum of rate x tokens x posterior_k should equal
   weight_k x total; the squared misses (each divided by its domain's scale) are minimised by projected gradient steps
   r <- clip(r0 - g . p): g adds up the (scaled) gradients of all steps, which the projection then cuts at once. A step is one
   distributed sum of K and K x K numbers for each of four step sizes; the rates stay one short column expression.

total None: the largest for which no domain needs more than max_rate times what it has, less SLACK, and two in a hundred more
as long as the targets can't be met (ten times at most; then the first again, as near as it came): without slack every document with some of the scarcest domain
would have to stay whole, whatever else it holds.

Edge cases: a null or empty text has no tokens, the prior as posterior, and the rate that follows; null ids are mixed like
others; null domains aren't learned; domains without a target have weight 0; without any label every document gets the same rate; an
empty table gives an empty result. Clashing column names can't arise: only id and text are read. Very long texts: a task holds a
text's words, some 60 bytes each; rates don't depend on ties, and rows that repeat an id are drawn alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelgraph.llm.training import sample_ids
from voxelgraph.storage import durable

BUCKETS, PER_CLASS, TEMPER, LEAST, MARGIN, SLACK = 1 << 18, 3000, 100.0, 4, 1.0, 0.04


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def likelihoods(docs: DataFrame, ids: DataFrame, buckets: int = BUCKETS, least: int = LEAST, margin: float = MARGIN) -> tuple[list, DataFrame]:
    """The domains; bucket, ll: how far each domain's log-likelihood (add-half smoothing) is below the best, less the margin. ids: a bounded
    table of doc_id, label. A document counts a word once; buckets of fewer than `least` documents say nothing and are left out."""
    known = docs.join(F.broadcast(ids), docs.doc_id == ids.doc_id).select("label", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    counts = durable(known.groupBy(_bucket(F.col("word"), buckets).alias("bucket"), "label").agg(F.count(F.lit(1)).alias("n")))
    domains = sorted(r.label for r in counts.select("label").distinct().collect())
    if not domains:
        return domains, counts.select("bucket", F.array().cast("array<double>").alias("ll"))
    n_of = [f"n{k}" for k in range(len(domains))]
    each = counts.groupBy("bucket").agg(*[F.coalesce(F.sum(F.when(F.col("label") == d, F.col("n"))), F.lit(0)).alias(c) for d, c in zip(domains, n_of)])
    each = durable(each.where(" + ".join(n_of) + f" >= {least}"))
    n, *known = each.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0)) for c in n_of]).first()
    # Small differences between domains come from topic or language and add up over long texts: only what is beyond the margin counts.
    raw = [F.log((F.col(c) + 0.5) / F.lit(float(t + 0.5 * max(n, 1)))) for c, t in zip(n_of, known)]
    top = F.greatest(*raw) if len(raw) > 1 else raw[0]
    return domains, each.select("bucket", F.array(*[F.least(F.lit(0.0), x - top + margin) for x in raw]).alias("ll"))


def evidence(docs: DataFrame, domains: list, model: DataFrame, buckets: int = BUCKETS, temper: float = TEMPER) -> DataFrame:
    """doc_id, tokens (words), s (summed log-likelihoods of each domain, tempered) for every row."""
    k = len(domains)
    split = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_row"), F.size(words(F.col("text"))).cast("long").alias("tokens"), F.array_distinct(words(F.col("text"))).alias("_words"))
    if not k:
        return split.select("doc_id", "tokens", F.array().cast("array<double>").alias("s"))
    one = split.select("doc_id", "_row", "tokens", F.posexplode_outer("_words").alias("_at", "_word"))
    one = one.withColumn("bucket", _bucket(F.col("_word"), buckets)).join(F.broadcast(model), "bucket", "left")
    sums = [F.coalesce(F.sum(F.col("ll")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(k)]
    # Copies of a row are summed together and told apart again by their number.
    copies = F.sum(F.when(F.coalesce(F.col("_at"), F.lit(0)) == 0, 1).otherwise(0)).alias("_copies")
    per = one.groupBy("doc_id", "_row", "tokens").agg(*sums, F.count("ll").alias("_n"), copies)
    power = F.lit(temper) / F.greatest(F.lit(temper), F.col("_n") / F.col("_copies")) / F.col("_copies")
    out = per.select("doc_id", "tokens", "_copies", F.array(*[power * F.col(f"s{i}") for i in range(k)]).alias("s"))
    return out.select("doc_id", "tokens", "s", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).drop("_copy")


def calibrated(s: np.ndarray, own: np.ndarray, share: np.ndarray, steps: int = 400) -> np.ndarray:
    """(K, K + 1) weights and biases of a softmax over the evidence, from labelled rows that the likelihoods haven't seen, each domain
    weighing as its share of all labels."""
    k = len(share)
    scale = max(float(np.abs(s).mean()), 1e-9) if s.size else 1.0
    x = np.column_stack([s / scale, np.ones(len(s))])
    w = np.column_stack([np.eye(k) * scale, np.log(np.maximum(share, 1e-9))])
    count = np.bincount(own, minlength=k)
    if (count == 0).any():
        return np.column_stack([w[:, :k] / scale, w[:, k]])
    weight = (share / count)[own]
    weight = weight / weight.sum()
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = x @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(own)), own] -= 1
        g = (p * weight[:, None]).T @ x + 1e-4 * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return np.column_stack([w[:, :k] / scale, w[:, k]])


def posteriors(found: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, tokens, p (the posterior of each domain). found: what evidence() gives."""
    k = len(weights)
    if not k:
        return found.select("doc_id", "tokens", F.col("s").alias("p"))
    logit = []
    for row in weights:
        z = F.lit(float(row[k]))
        for j in range(k):
            z = z + F.lit(float(row[j])) * F.col("s")[j]
        logit.append(z)
    top = F.greatest(*logit) if k > 1 else logit[0]
    raw = found.select("doc_id", "tokens", F.array(*[F.exp(x - top) for x in logit]).alias("_e"))
    total = F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)
    return raw.select("doc_id", "tokens", F.transform("_e", lambda x: x / total).alias("p"))


def memberships(docs: DataFrame, labelled: DataFrame, per_class: int = PER_CLASS) -> tuple[list, DataFrame]:
    """The domains, and doc_id, tokens, p for every row. Half of the sampled labels teach the likelihoods, the other half calibrates."""
    ids = durable(sample_ids(labelled.select("doc_id", F.col("domain").alias("label")), per_class))
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    domains, model = likelihoods(docs, ids.where(half == 0))
    if not domains:
        return [], posteriors(evidence(docs, domains, model), np.zeros((0, 1)))
    share = {r.domain: r["count"] for r in labelled.where("domain is not null").groupBy("domain").count().collect()}
    share = np.array([share[d] for d in domains], float)
    rest = ids.where(half == 1).where(F.col("label").isin(domains))
    rows = docs.join(F.broadcast(rest.select("doc_id")), "doc_id", "left_semi")
    seen = evidence(rows, domains, model).join(F.broadcast(rest), "doc_id").select("label", "s").collect()
    s = np.array([r.s for r in seen], float).reshape(len(seen), len(domains))
    weights = calibrated(s, np.array([domains.index(r.label) for r in seen], int), share / share.sum())
    return domains, posteriors(evidence(docs, domains, model), weights)


@dataclass
class Mix:
    domains: list
    target: list[float]
    expected: list[float]
    steps: int
    rates: DataFrame = field(repr=False)


def fit_rates(members: DataFrame, domains: list, weights: dict, total: float | None = None, max_rate: float = 1.0, steps: int = 30, close: float = 3e-3, slack: float = SLACK) -> Mix:
    """Rates for members (doc_id, tokens, p), which miss no domain's target by more than `close` of that target (of the total where the
    target is 0), or come as near as the steps allow. members should be a written table: it is read once a step. A weight for a
    domain that nothing is known of is refused."""
    k = len(domains)
    if domains and (unknown := sorted(d for d, x in weights.items() if x > 0 and d not in domains)):
        raise ValueError(f"no labels for the domains {unknown}")
    if not k:
        return Mix([], [], [], 0, members.withColumn("rate", F.lit(float(max_rate))))
    p = [F.col("p")[i] for i in range(k)]
    tokens = F.col("tokens").cast("double")
    have = np.array([x or 0.0 for x in members.agg(*[F.sum(tokens * x) for x in p]).first()])
    w = np.array([float(weights.get(d, 0)) for d in domains])
    w = w / w.sum() if w.sum() > 0 else np.full(k, 1 / k)
    need = w > 0
    most = float((max_rate * have[need] / w[need]).min())
    totals = [float(total)] if total is not None else [most * (1 - slack - 0.02 * n) for n in range(11)]
    moment = members.agg(*[F.sum(tokens * p[i] * p[j]) for i in range(k) for j in range(i, k)]).first()
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = [x or 0.0 for x in moment]
    m = m + m.T - np.diag(np.diag(m))
    # Misses are weighed by 1 / scale, so that small domains converge as fast as large ones; 1 / reach is then a safe step.
    scale = np.sqrt(np.maximum(np.diag(m), 1e-9))
    reach = max(np.linalg.eigvalsh(m / np.outer(scale, scale)).max(), 1e-9)

    def moved(start: Column, g: list[Column]) -> Column:
        r = start
        for x, y in zip(g, p):
            r = r - x * y
        return F.greatest(F.lit(0.0), F.least(F.lit(float(max_rate)), r))

    def measured(*tried: tuple[float, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each start and direction, in one pass: expected totals, and second moments of the documents that are not held at a bound.
        They are rows and not literals of the sums, so that every step runs the same generated code."""
        each = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("start"), F.array(*[F.lit(float(x)) for x in g]).alias("g")) for n, (a, g) in enumerate(tried)])
        rows = members.select("tokens", "p", F.explode(each).alias("_t"))
        rows = rows.select("tokens", "p", F.col("_t.n").alias("_n"), moved(F.col("_t.start"), [F.col("_t.g")[i] for i in range(k)]).alias("_r"))
        r = F.col("_r")
        free = F.when((r > 0) & (r < max_rate), tokens).otherwise(0.0)
        sums = [F.sum(r * tokens * x) for x in p] + [F.sum(free * p[i] * p[j]) for i in range(k) for j in range(i, k)]
        found = {row[0]: np.array([x or 0.0 for x in row[1:]]) for row in rows.groupBy("_n").agg(*sums).collect()}
        out = []
        for n in range(len(tried)):
            got, f = found.get(n, np.zeros(k + k * (k + 1) // 2)), np.zeros((k, k))
            f[np.triu_indices(k)] = got[k:]
            out.append((got[:k], f + np.triu(f, 1).T))
        return out

    done, all_tokens, tried_all = 0, have.sum(), []
    for total in totals:
        target, start = w * total, float(min(max_rate, total / all_tokens)) if all_tokens else 0.0
        unit = np.maximum(np.where(target > 0, target, total), 1e-9)  # misses count relative to each domain's target
        gone, sizes = np.zeros(k), []
        best, free = measured((start, gone))[0]
        for _ in range(steps):
            e = best - target
            sizes.append(float(np.linalg.norm(e / unit)))
            # Met; or not to be met: five steps in a row gained less than a tenth each.
            if (np.abs(e) <= close * unit).all() or len(sizes) > 5 and sizes[-1] > 0.9**5 * sizes[-6]:
                break
            done += 1
            # The gradient scaled by the free documents' moments, parts of that, and, where the bounds spoil all, the plain scaled step.
            newton = np.linalg.lstsq(free + 1e-6 * np.diag(scale**2), e, rcond=None)[0]
            tried = [gone + g for g in (newton, newton / 3, newton / 10, e / scale**2 / reach)]
            found = measured(*[(start, g) for g in tried])
            n = int(np.argmin([np.linalg.norm((now - target) / unit) for now, _ in found]))
            gone, (best, free) = tried[n], found[n]
        tried_all.append((target, best, start, gone))
        if (np.abs(best - target) <= close * unit).all():
            break
    else:  # none can be met: the largest total, as near as it came
        target, best, start, gone = tried_all[0]
    rate = moved(F.lit(start), [F.lit(float(x)) for x in gone])
    return Mix(domains, target.tolist(), best.tolist(), done, members.withColumn("rate", rate))


def taken(rate: Column, *key: Column) -> Column:
    """How often a row is taken: the whole part of its rate, once more with the rest's probability, by a hash of its key."""
    draw = F.pmod(F.xxhash64(F.lit("mix"), *key), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("int")


def mix_documents(docs: DataFrame, labelled: DataFrame, weights: dict, id_col: str = "doc_id", text: str = "text", total: float | None = None, max_rate: float = 1.0, per_class: int = PER_CLASS) -> Mix:
    """rates: doc_id, tokens, p, rate, n_taken for every row. labelled: doc_id, domain; weights: domain -> share of the tokens."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    domains, found = memberships(rows, labelled, per_class)
    members = durable(found)
    mix = fit_rates(members, domains, weights, total, max_rate)
    mix.rates = mix.rates.withColumn("n_taken", taken(F.col("rate"), F.col("doc_id")))
    return mix


def quality_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain from the table of labels: toxic, low or clean."""
    return labels.where("quality is not null or toxic is not null").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("clean").alias("domain"))
