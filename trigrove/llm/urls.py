"""URL filter: suffix rules, and gradient-boosted trees on lexical features where no rule fits."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigrove.llm.common import map_arrow, read, sample_of, written

#: (verdict, host suffix, path prefix); the longest that fits wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words of host names that mark a URL as to be blocked when the trees' labels are made.
SEEDS = ("ads", "adult", "bet", "bets", "casino", "escort", "gambling", "loan", "loans", "pills", "poker", "porn", "sex", "slots", "spam", "track", "viagra", "warez", "xxx")
#: Distinct labelled URLs that the trees are trained on at most (the smallest hashes of the URL; a documented bound).
FIT_ROWS = 20_000
#: Host suffixes whose share of blocked URLs is a feature, at most: those most frequent in the training rows.
SUFFIXES = 256


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one or for null."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    fitting = None
    for verdict, name, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        value = F.struct(F.lit(f"{name}{prefix}").alias("rule"), F.lit(verdict).alias("verdict"))
        fitting = F.when(fits, value) if fitting is None else fitting.when(fits, value)
    return fitting


def suffixes_of(host: str) -> list[str]:
    """The host's last labels: one, two and three of them."""
    parts = host.split(".")
    return [".".join(parts[-k:]) for k in (1, 2, 3) if len(parts) >= k]


def features(urls: list[str | None], hosts: list[str], paths: list[str], share: dict[str, float], base: float) -> np.ndarray:
    """One row of numbers per URL: lengths, depth, digit and sign ratios, entropies, parameters, suffix statistics."""
    out = np.zeros((len(urls), 22 + 3), np.float64)
    for row, url, host, path in zip(out, urls, hosts, paths, strict=True):
        url = url or ""
        query = url.partition("?")[2].partition("#")[0]
        codes = np.frombuffer(url.encode("utf-32-le"), np.uint32)
        counts = np.unique(codes, return_counts=True)[1] if len(codes) else np.zeros(0)
        p = counts / max(1, len(codes))
        parts = [x for x in path.split("/") if x]
        n = max(1, len(url))
        row[:22] = (
            len(url), len(host), len(path), len(query), host.count("."), len(parts), path.count("-") + path.count("_"),
            sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host), sum(not c.isalnum() for c in url) / n,
            float(-(p * np.log2(p)).sum()) if len(p) else 0.0, query.count("=") + (query != "" and "=" not in query), query.count("&"), "#" in url,
            url[:8].lower() == "https://", host.startswith("www."), path.endswith("/"), "." in (parts[-1] if parts else ""),
            max(map(len, parts), default=0), len(parts[0]) if parts else 0, host.count("-"), max(map(len, host.split("."))),
        )
        known = [share.get(s, base) for s in suffixes_of(host)]
        row[22 : 22 + len(known)] = known
        row[22 + len(known) :] = base
    return out


@dataclass
class Trees:
    """Additive regression trees on binned features, for log odds."""

    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # by node: feature (-1: leaf), last bin to the left, value
    start: float
    rate: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        total = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(len(feature).bit_length()):
                f = feature[node]
                right = b[np.arange(len(x)), np.maximum(f, 0)] > cut[node]
                node = np.where(f >= 0, 2 * node + 1 + right, node)
            total += self.rate * value[node]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Gradient boosting for log loss with Newton leaves; each tree grows level by level on histograms."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    mean = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model = Trees(edges, [], float(np.log(mean / (1 - mean))), rate)
    b, total = model.binned(x), np.full(len(x), model.start)
    size = 2 ** (depth + 1) - 1
    for _ in range(rounds if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        node = np.zeros(len(x), int)
        for level in range(depth + 1):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                mine = np.flatnonzero(node == k)
                if not len(mine):
                    continue
                gs, hs = g[mine].sum(), h[mine].sum()
                value[k] = -gs / (hs + ridge)
                if level == depth:
                    continue
                best = (1e-6, -1, 0)
                for f in range(x.shape[1]):
                    gl = np.cumsum(np.bincount(b[mine, f], g[mine], bins))[:-1]
                    hl = np.cumsum(np.bincount(b[mine, f], h[mine], bins))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(hl < least) | (hs - hl < least)] = 0
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (float(gain[at]), f, at)
                if best[1] >= 0:
                    feature[k], cut[k] = best[1:]
                    node[mine] = 2 * k + 1 + (b[mine, best[1]] > best[2])
        total += rate * value[node]
        model.trees.append((feature, cut, value))
    return model


@dataclass
class UrlModel:
    share: dict[str, float]
    base: float
    trees: Trees

    def score(self, urls, hosts, paths) -> np.ndarray:
        """The likelihood that each URL is to be blocked."""
        return self.trees.score(features(urls, hosts, paths, self.share, self.base))


#: Parts of the training rows: each row's suffix shares come from the other parts, or they would give its label away.
FOLDS = 5


def shares(rows: list[tuple[str | None, str, str, int]], suffixes: int) -> tuple[dict[str, float], float]:
    """The share of blocked URLs of the most frequent suffixes, shrunk towards the whole share; and that."""
    base = sum(r[3] for r in rows) / len(rows) if rows else 0.0
    seen: dict[str, list[int]] = {}
    for _, host, _, blocked in rows:
        for s in suffixes_of(host):
            seen.setdefault(s, []).append(blocked)
    common = sorted(seen, key=lambda s: (-len(seen[s]), s))[:suffixes]
    return {s: (sum(seen[s]) + 10 * base) / (len(seen[s]) + 10) for s in common}, base


def learn(rows: list[tuple[str | None, str, str, int]], suffixes: int = SUFFIXES) -> UrlModel:
    """A model of (url, host, path, blocked). In training a row's suffix shares are those of the other rows' parts."""
    part = [zlib.crc32((r[0] or "").encode("utf-8", "surrogatepass")) % FOLDS for r in rows]
    x = np.zeros((len(rows), 25))
    for k in range(FOLDS):
        mine = [i for i, p in enumerate(part) if p == k]
        share, base = shares([r for r, p in zip(rows, part, strict=True) if p != k], suffixes)
        x[mine] = features([rows[i][0] for i in mine], [rows[i][1] for i in mine], [rows[i][2] for i in mine], share, base)
    share, base = shares(rows, suffixes)
    return UrlModel(share, base, boost(x, np.array([r[3] for r in rows], float)))


def split(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path and the fitting rule with its verdict (null where none fits)."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fit = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    return fit.select("page_id", "url", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("verdict"))


def judged(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, most: int = FIT_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page.

    Where a rule fits, the verdict is the rule's. Elsewhere it is the trees': ``block`` from a score of 0.5. They learn
    from ``labelled`` (url, label 0 or 1), by default from the pages' own URLs: a rule's verdict is a label where one
    fits, elsewhere a host with a word of SEEDS is to be blocked and others aren't. Null and malformed URLs have an
    empty host and path and are judged by the trees; without labels every such URL is allowed. The trees learn from a
    repeated URL once for each of its labels. Repeated rows are judged each for itself.
    """
    parts = split(pages, rules)
    if labelled is None:
        seeded = F.arrays_overlap(F.split("host", r"[.\-]"), F.array(*map(F.lit, SEEDS)))
        known = parts.select("url", "host", "path", F.coalesce(F.col("verdict") == "block", seeded).cast("int").alias("y"))
    else:
        known = labelled.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("int").alias("y"))
    # distinct, so that a frequent URL can't fill the sample
    rows = sample_of(known.where("y IS NOT NULL").distinct(), most, "url", "y").collect()
    model = learn([(r["url"], r["host"], r["path"], r["y"]) for r in rows])

    def run(batch: pa.RecordBatch) -> dict:
        c = {k: batch.column(k) for k in ("page_id", "host", "path", "rule", "verdict")}
        score = model.score(batch.column("url").to_pylist(), c["host"].to_pylist(), c["path"].to_pylist())
        given = c["verdict"].to_pylist()
        c["verdict"] = [g or ("block" if s >= 0.5 else "allow") for g, s in zip(given, score.tolist(), strict=True)]
        return c | {"score": score}

    return map_arrow(parts.withColumn("page_id", F.col("page_id").cast("long")), run, "page_id long, host string, path string, rule string, verdict string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    # only ids and URLs are kept of the pages, so the model's training and the judging read few bytes
    return judged(written(read(spark, sf_dir, "pages").select("page_id", "url"), "urls"))


def rules_query(spark, sf_dir: str) -> DataFrame:
    """What doesn't depend on the trees: page_id, host, path, rule and the rule's verdict."""
    return split(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: The rows of ``rules_query`` in DuckDB SQL.
RULES_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(verdict, name, prefix) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT page_id, arg_max(name || prefix, length(name || prefix)) AS rule, arg_max(verdict, length(name || prefix)) AS verdict
  FROM p JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix) GROUP BY page_id)
SELECT p.page_id, host, path, rule, verdict FROM p LEFT JOIN fits USING (page_id)
"""
