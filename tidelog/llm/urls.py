"""URL filters: host and path rules, else gradient-boosted trees on lexical features.

All on DataFrame functions: features and their bins are columns, every level of every tree is one grouped sum of
gradients over (leaf, feature, bin), whose few rows pick the splits on the driver, and the trained trees are one nested
``CASE`` expression. Trees learn from labelled URLs, of which at most ``sample`` are used, chosen by hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, sheltered, unsheltered

# The rules, as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Length, depth, digit ratio, entropy, parameter counts and suffix statistics of a URL, and some more of its host.
FEATURES = ("length", "host_length", "depth", "host_parts", "digit_ratio", "host_digits", "entropy", "parameters", "hyphens", "hyphen_words", "suffix_rate")

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and the rest of ``url``; empty where it is null or has no ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring_index(url, "://", 1)
    rest = F.when(has, F.substr(url, F.length(rest) + 4)).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    after = F.substr(rest, F.length(host) + 1)
    path = F.regexp_extract(after, r"\A[^?#]*", 0)
    return F.translate(host, *LOWER), path, F.substr(after, F.length(path) + 1)


def ruled(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The fitting rule as ``struct(rule, verdict)``, the longest where several fit, null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def described(urls: DataFrame, rates: dict[str, float], usual: float) -> DataFrame:
    """``urls(url, ...)`` plus ``_host, _path, _rest``, and a column ``_x_<name>`` for each of ``FEATURES``.

    Built in steps, so that the optimiser keeps each part of the URL as one column instead of copying its expression into every feature.
    """
    host, path, rest = parts(F.col("url"))
    urls = urls.select("*", host.alias("_host"), path.alias("_path"), rest.alias("_rest"), F.coalesce("url", F.lit("")).alias("_u"))
    urls = urls.select(
        "*",
        F.greatest(F.length("_host"), F.lit(1)).alias("_n"),
        F.regexp_extract("_rest", r"\A\?([^#]*)", 1).alias("_query"),
        F.regexp_extract("_host", r"([^.]*)\.[^.]*\.[^.]*\z", 1).alias("_name"),
        F.substring_index("_host", ".", -1).alias("_suffix"),
    )
    count = lambda s, p: F.length(s) - F.length(F.regexp_replace(s, p, ""))
    filled = lambda s, p: F.size(F.filter(F.split(s, p), lambda x: x != ""))
    share = lambda c: (F.length("_host") - F.length(F.translate("_host", c, ""))) / F.col("_n")
    shares = F.array(*[share(c) for c in LOWER[1] + "0123456789-._"])
    rate = F.element_at(F.create_map(*[F.lit(v) for kv in rates.items() for v in kv]), F.col("_suffix")) if rates else F.lit(None)
    x = {
        "length": F.length("_u"),
        "host_length": F.length("_host"),
        "depth": filled("_path", "/"),
        "host_parts": filled("_host", r"\."),
        "digit_ratio": count("_u", "[0-9]") / F.greatest(F.length("_u"), F.lit(1)),
        "host_digits": count("_host", "[0-9]") / F.col("_n"),
        "entropy": F.aggregate(shares, F.lit(0.0), lambda e, q: e - F.when(q > 0, q * F.log2(q)).otherwise(0.0)),
        "parameters": F.when(F.col("_query") == "", 0).otherwise(F.size(F.split("_query", "&"))),
        "hyphens": count("_host", "-"),
        "hyphen_words": F.size(F.split(F.when(F.col("_name") == "", F.col("_host")).otherwise(F.col("_name")), "-")),
        "suffix_rate": F.coalesce(rate, F.lit(usual)),
    }
    return urls.select("*", *[x[k].cast("double").alias(f"_x_{k}") for k in FEATURES]).drop("_u", "_n", "_query", "_name", "_suffix")


def labelled_urls(spark: SparkSession, n: int = 6000) -> DataFrame:
    """``url, label`` (1: to block): ``n`` URLs made by rule, every second one to block.

    Words are random letters. What is to block has hyphens and digits in its host, words of few letters, deep paths, parameters and some suffixes more often
    than what is not, each by chance and on its own: no single trait tells the two apart.
    """
    pick = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k)).cast("int")
    bad = F.pmod("id", F.lit(2)) == 1
    often = lambda salt, yes, no: pick(salt, 100) < F.when(bad, yes).otherwise(no)
    # hexadecimal digits as letters: many different ones, or three of them again and again
    letters = lambda salt, least, spread: F.translate(F.substring(F.sha2(F.concat_ws(":", "id", F.lit(salt)), 256), F.lit(1), least + pick(salt, spread)), "0123456789", "ghiklmnort")
    few = lambda word: F.translate(word, "abcdefghiklmnort", "aeoaeoaeoaeoaeoa")
    word = lambda salt: F.when(often(salt + 50, 35, 4), few(letters(salt, 4, 5))).otherwise(letters(salt, 4, 5))
    name = F.concat(word(1), F.when(often(2, 70, 6), F.concat(F.lit("-"), word(3))).otherwise(""), F.when(often(4, 40, 3), F.concat(F.lit("-"), word(5))).otherwise(""), F.when(often(6, 45, 4), pick(7, 1000).cast("string")).otherwise(""))
    front = F.when(pick(8, 3) == 0, F.concat(letters(9, 1, 4), F.lit("."))).otherwise("")
    ends = lambda salt, names: F.get(F.array(*map(F.lit, names)), pick(salt, len(names)))
    end = F.when(often(10, 45, 15), ends(11, ("info", "biz", "top"))).otherwise(ends(12, ("com", "org", "net")))
    host = F.concat(front, name, F.when(pick(13, 2) == 0, F.concat(F.lit("."), letters(14, 5, 4))).otherwise(""), F.lit("."), end)
    depth = F.when(often(15, 50, 10), 4 + pick(16, 4)).otherwise(1 + pick(17, 3))
    path = F.concat(F.lit("/"), F.array_join(F.slice(F.array(*[F.when(pick(20 + i, 2) == 0, letters(30 + i, 2, 6)).otherwise(pick(40 + i, 100000).cast("string")) for i in range(7)]), F.lit(1), depth), "/"))
    query = F.when(often(18, 55, 12), F.concat(F.lit("?"), F.array_join(F.slice(F.array(*[F.concat(letters(60 + i, 1, 4), F.lit("="), letters(70 + i, 1, 8)) for i in range(5)]), F.lit(1), F.when(bad, 1 + pick(19, 5)).otherwise(1 + pick(19, 2))), "&"))).otherwise("")
    return spark.range(n).select(F.concat(F.when(pick(80, 2) == 0, "http://").otherwise("https://"), host, path, query).alias("url"), bad.cast("int").alias("label"))


@dataclass
class Trees:
    """Boosted trees over ``FEATURES``, with the suffix statistic and the starting log-odds."""

    trees: list[dict]
    suffixes: dict[str, float]
    usual: float
    start: float

    def described(self, urls: DataFrame) -> DataFrame:
        return described(urls, self.suffixes, self.usual)

    def margin(self) -> Column:
        """Log-odds of a row of ``described``."""
        return sum((_walk(t) for t in self.trees), F.lit(self.start))


def _walk(t: dict) -> Column:
    if "leaf" in t:
        return F.lit(t["leaf"])
    return F.when(F.col("_x_" + t["feature"]) <= t["at"], _walk(t["low"])).otherwise(_walk(t["high"]))


def _leaf(t: dict, leaves: dict[int, dict]) -> Column:
    """Number of the open leaf that a row falls into; -1 for finished ones."""
    if "feature" in t:
        return F.when(F.col("_x_" + t["feature"]) <= t["at"], _leaf(t["low"], leaves)).otherwise(_leaf(t["high"], leaves))
    return F.lit(next((k for k, v in leaves.items() if v is t), -1))


def train(labelled: DataFrame, sample: int = 20000, rounds: int = 12, depth: int = 3, bins: int = 16, rate: float = 0.4) -> Trees:
    """Boost ``rounds`` trees on the logistic loss of ``labelled(url, label)``; rows with null url or another label than 0 and 1 are left out.

    Suffix statistics are of every suffix in the sample, drawn towards the usual rate by 20 rows.
    """
    # cut, here and below: each level of each tree is a job, whose plan would hold the expressions of all features and trees
    rows = cut(labelled.where(F.col("url").isNotNull() & F.col("label").isin(0, 1)).select("url", "label").orderBy(F.xxhash64("url"), "url", "label").limit(sample))
    base = rows.agg(F.sum(F.col("label").cast("double")), F.count("*")).first()
    pos, n = base[0] or 0.0, base[1]
    usual = (pos + 1) / (n + 2)
    stats = rows.groupBy(F.substring_index(parts(F.col("url"))[0], ".", -1).alias("s")).agg(F.sum("label").alias("p"), F.count("*").alias("n")).orderBy(F.desc("n"), "s").collect()
    model = Trees([], {r["s"]: (r["p"] + 20 * usual) / (r["n"] + 20) for r in stats}, usual, math.log(usual / (1 - usual)))
    if not n or pos in (0, n):
        return model
    data = cut(model.described(rows).select(F.col("label").cast("double").alias("y"), F.lit(model.start).alias("m"), *[f"_x_{k}" for k in FEATURES]))
    edges = data.agg(*[F.percentile_approx(f"_x_{k}", [i / bins for i in range(1, bins)], 1000).alias(k) for k in FEATURES]).first()
    edges = {k: sorted(set(edges[k])) for k in FEATURES}
    bin_of = lambda k: sum((F.when(F.col(f"_x_{k}") > e, 1).otherwise(0) for e in edges[k]), F.lit(0))
    data = cut(data.withColumn("binned", F.array(*[F.struct(F.lit(i).alias("f"), bin_of(k).alias("bin")) for i, k in enumerate(FEATURES)])))

    p = 1 / (1 + F.exp(-F.col("m")))
    for _ in range(rounds):
        root: dict = {}
        leaves = {0: root}
        for level in range(depth):
            got = data.select(_leaf(root, leaves).alias("leaf"), (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h"), F.explode("binned").alias("s")).where("leaf >= 0")
            sums = got.groupBy("leaf", "s.f", "s.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # leaves x features x bins
            table: dict = {}
            for r in sums:
                table.setdefault(r["leaf"], {}).setdefault(r["f"], {})[r["bin"]] = (r["g"], r["h"])
            new: dict[int, dict] = {}
            for k, t in leaves.items():
                feats = table.get(k, {})
                g, h = (sum(v[i] for v in feats.get(0, {}).values()) for i in (0, 1))
                best = None
                for f, by in sorted(feats.items()):
                    gl = hl = 0.0
                    for b, edge in enumerate(edges[FEATURES[f]]):
                        gl, hl = gl + by.get(b, (0, 0))[0], hl + by.get(b, (0, 0))[1]
                        gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                        if hl > 1 and h - hl > 1 and gain > 1e-3 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, FEATURES[f], edge, (gl, hl), (g - gl, h - hl))
                if best is None:
                    t["leaf"] = round(-rate * g / (h + 1), 6)
                    continue
                low, high = ({"leaf": round(-rate * gg / (hh + 1), 6)} if level + 1 == depth else {} for gg, hh in best[3:])
                t |= {"feature": best[1], "at": best[2], "low": low, "high": high}
                new[2 * k + 1], new[2 * k + 2] = low, high
            leaves = new
            if not leaves:
                break
        model.trees.append(root)
        data = cut(data.withColumn("m", F.col("m") + _walk(root)))
    return model


def judge(pages: DataFrame, model: Trees, rules: tuple = RULES, block_at: float = 0.5) -> DataFrame:
    """``pages`` plus ``host, path, rule, verdict, score``: the rule's verdict, else the trees' (block from ``block_at`` up).

    ``score`` is the trees' likelihood of a URL to block, whatever the rules say. Defined cases: a null url or one
    without ``://`` has empty host and path, fits no rule and is judged by the trees; very long urls are read whole; repeated
    rows are each judged; other columns pass through, those named like the results are replaced.
    """
    new = ("host", "path", "rule", "verdict", "score")
    pages, kept = sheltered(pages.select(*[c for c in pages.columns if c not in new]), ("url",))
    names = pages.columns
    out = model.described(pages).withColumn("score", 1 / (1 + F.exp(-model.margin())))
    out = out.withColumn("_r", ruled(F.col("_host"), F.col("_path"), rules))
    verdict = F.coalesce(F.col("_r.verdict"), F.when(F.col("score") >= block_at, "block").otherwise("allow"))
    out = out.select(*names, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "score")
    return unsheltered(out, kept)
