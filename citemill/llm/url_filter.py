"""URL filtering by mined association rules; DataFrame functions only.

A URL becomes a set of tokens: labels of its host (with their place from the right),
path segments (with their place; runs of digits as ``#``), query names, and
the scheme.  Fixed host-and-path rules label the URLs they fit.  Tokens that occur in
the same labelled URLs are one *class*, which a URL has by any of them.  FP-growth
mines combinations of classes together with a label; combinations of enough support
and confidence, and better than each of their own parts, become rules.  A class
that has one label only, or that every labelled URL has, betters no combination, so it
is judged alone and not mined.  An inverted index from token to class to rules matches
every URL: a rule fits when it is hit by as many classes as it has, and the best by
confidence, support and place decides.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

ALLOW, BLOCK = "allow", "block"
#: Rules (verdict, host, path prefix) that the query judges by.
RULES = [(ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"), (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/")]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.contains(url, F.lit("://")), F.substring(url, F.length(F.substring_index(url, "://", 1)) + 4, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """Then up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL; an empty array where there is no host and path."""
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    shape = lambda x: F.regexp_replace(x, r"\d+", "#")
    names = F.transform(F.filter(F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    scheme = F.array(F.concat(F.lit("s:"), F.substring_index(url, "://", 1)))
    all_ = F.concat(
        scheme,
        F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), shape(x))),
        F.transform(parts, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), shape(x))),
        names,
    )
    return F.when((host == "") & (path == ""), F.array().cast("array<string>")).otherwise(F.coalesce(F.array_distinct(all_), F.array().cast("array<string>")))


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """Index of the rule that decides, or null: the longest (host and path together,
    then host) of those whose host is the URL's or a parent of it and whose path
    starts the URL's; of equals the first given."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), -len(rules[i][1]), i))
    out = F.lit(None).cast("int")
    for i in reversed(order):
        _, h, p = rules[i]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def token_classes(labelled: DataFrame, least: int) -> list[tuple[list[str], int, dict]]:
    """(tokens, rows, rows by label) of each class of at least ``least`` of the rows (tokens, label).  A row has
    few tokens, so no more than its mean number by the support reach the driver."""
    kinds = labelled.groupBy("tokens", "label").count().withColumn("row", F.xxhash64("tokens", "label"))
    each = kinds.select(F.explode("tokens").alias("token"), "label", "count", "row").groupBy("token", "label").agg(F.sum("count").alias("k"), F.bit_xor("row").alias("rows"))
    by_token = each.groupBy("token").agg(F.sum("k").alias("k"), F.bit_xor("rows").alias("rows"), F.collect_list(F.struct("label", "k")).alias("by")).where(F.col("k") >= least)
    out: dict[tuple, tuple[list[str], int, dict]] = {}
    for r in by_token.orderBy("token").collect():
        by = dict(sorted(tuple(x) for x in r["by"]))
        out.setdefault((r["k"], r["rows"], *by.items()), ([], r["k"], by))[0].append(r["token"])
    return list(out.values())


Rule = tuple[list[list[str]], str, float, float]  # classes of tokens, verdict, confidence, support


def mine(labelled: DataFrame, *, min_support: float, min_confidence: float) -> list[Rule]:
    """Rules, best first, from rows (tokens, label).

    A rule is kept if no rule on part of its classes has the same verdict with
    at least its confidence.  FP-growth runs over all labelled rows, distributed, on
    the classes that occur with several labels; ``min_support`` bounds what it finds, and
    the driver holds the kept rules and a partition of the others.
    """
    n = labelled.count()
    least = -(-int(min_support * n * 1_000_000) // 1_000_000)
    classes = token_classes(labelled, max(1, least))
    found = [((c,), v, k / rows, k) for c, (_, rows, by) in enumerate(classes) for v, k in by.items() if k / rows >= min_confidence and k >= min_support * n]
    mixed = [c for c, (_, rows, by) in enumerate(classes) if len(by) > 1 and rows < n]
    if len(mixed) > 1:
        # a class is named by its place, after the labels' sign
        known = F.create_map(*[F.lit(x) for c in mixed for t in classes[c][0] for x in (t, str(c))])
        held = F.array_distinct(F.filter(F.transform("tokens", lambda t: F.try_element_at(known, t)), lambda c: c.isNotNull()))
        items = labelled.select(F.concat(held, F.array(F.concat(F.lit("="), "label"))).alias("items"))
        sets = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items).freqItemsets
        is_label = lambda x: x.startswith("=")
        split = sets.select(F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("places"), F.get(F.transform(F.filter("items", is_label), lambda x: F.substring(x, 2, 1_000_000)), 0).alias("verdict"), "freq").where(F.size("places") > 1)
        whole = split.where("verdict is null").select("places", F.col("freq").alias("seen"))
        scored = split.where("verdict is not null").join(whole, "places").withColumn("confidence", F.col("freq") / F.col("seen")).where(F.col("confidence") >= min_confidence)
        rows = scored.orderBy(F.size("places"), F.desc("confidence"), F.desc("freq"), "places", "verdict").toLocalIterator()
    else:
        rows = iter(())
    kept: list = []
    at: dict = {}  # kept rules by verdict and first class

    def keep(places: tuple, verdict: str, confidence: float, freq: int) -> None:
        has = set(places)
        if not any(part <= has and better >= confidence for c in has for part, better in at.get((verdict, c), ())):
            kept.append(([classes[c][0] for c in places], verdict, confidence, freq / n))
            at.setdefault((verdict, places[0]), []).append((has, confidence))

    for rule in found:
        keep(*rule)
    for r in rows:  # short ones first, so parts come before what holds them
        keep(tuple(map(int, r["places"])), r["verdict"], r["confidence"], r["freq"])
    return sorted(kept, key=lambda r: (-r[2], -r[3], r[0], r[1]))


def indexed_match(tokens: Column, mined: list[Rule]) -> Column:
    """Place of the best rule all of whose classes the URL has, or null: an inverted
    index held as a map from token to class and an array from class to places of rules."""
    if not mined:
        return F.lit(None).cast("int")
    places: dict[tuple[str, ...], int] = {}
    rules_of: list[list[int]] = []
    for k, (classes, _, _, _) in enumerate(mined):
        for c in map(tuple, classes):
            if c not in places:
                places[c] = len(rules_of)
                rules_of.append([])
            rules_of[places[c]].append(k)
    table = F.create_map(*[F.lit(x) for c, i in places.items() for t in c for x in (t, i)])
    held = F.array_distinct(F.filter(F.transform(tokens, lambda t: F.try_element_at(table, t)), lambda c: c.isNotNull()))
    index = F.array(*[F.array(*map(F.lit, ks)) for ks in rules_of])
    sizes = F.array(*[F.lit(len(r[0])) for r in mined])
    hits = F.flatten(F.transform(held, lambda c: F.get(index, c)))
    full = F.filter(F.array_distinct(hits), lambda k: F.size(F.filter(hits, lambda x: x == k)) == F.get(sizes, k))
    return F.array_min(full)


def judge(pages: DataFrame, *, key: str = "page_id", url: str = "url", rules=RULES, default: str = ALLOW, min_support: float = 0.01, min_confidence: float = 0.8) -> DataFrame:
    """Judge every URL: key, host, path, rule (like ``net/``, else null), verdict, and
    the classes of the mined rule that decided (``mined``, tokens of one class with bars between, else null).

    A fixed rule decides first; else the best mined rule; else ``default``.  Null URLs
    and those without ``://`` have empty host and path and get the default; repeated
    rows give repeated rows; an empty table, or none that a rule fits, mines
    nothing; a very long URL is read whole; of mined rules alike in confidence and support
    the first by tokens decides; other columns are ignored.  No row is shuffled: all mined rules travel in
    the plan.
    """
    u = F.col(url).cast("string")
    base = pages.select(F.col(key), u.alias("u")).select(key, "u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    base = base.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    verdicts, names = F.array(*[F.lit(r[0]) for r in rules]), F.array(*[F.lit(r[1] + r[2]) for r in rules])
    tokens = tokens_of(F.col("u"), F.col("host"), F.col("path"))
    labelled = base.where("fit is not null").select(tokens.alias("tokens"), F.get(verdicts, F.col("fit")).alias("label"))
    mined = mine(labelled, min_support=min_support, min_confidence=min_confidence) if not labelled.isEmpty() else []
    out = base.withColumn("hit", F.when(F.col("fit").isNull(), indexed_match(tokens, mined)))
    by = F.array(*[F.lit(r[1]) for r in mined]) if mined else F.array().cast("array<string>")
    said = F.array(*[F.lit(" ".join("|".join(c) for c in r[0])) for r in mined]) if mined else F.array().cast("array<string>")
    return out.select(key, "host", "path", F.get(names, F.col("fit")).alias("rule"), F.coalesce(F.get(verdicts, F.col("fit")), F.get(by, F.col("hit")), F.lit(default)).alias("verdict"), F.get(said, F.col("hit")).alias("mined"))
