"""URL filter by rules: a given list first, then association rules mined from labelled URLs.

A page is labelled by the row of ``labels`` with its id: block if toxic or of bad quality, else allow. Its URL is a
set of tokens (``tokens``); token sets that occur often together with a class are found level by level.

1. Token statistics come from all labelled URLs. Tokens that stand in just the same URLs (equal counts and equal
   XOR of row hashes) tell the same and are one item, the smallest of them.
2. Sets of k + 1 items are grown from those of k in the URLs that have them, with all items of every URL, and counted there
   (``frequent_sets``). A set that has just the URLs of a smaller one is not grown, nor one whose URLs all are of one class:
   no rule made of it would be kept. Nothing is capped, so the work grows with the number of sets that are left, which
   in URLs of very many unrelated frequent tokens grows with the power of their number. The levels are tables.
3. Rules are kept by support, confidence and deviation from the base rate, and dropped if a more general rule of
   the same class is as confident.
4. Matching goes through an inverted index: a rule is filed under its rarest token, a set looks up the rules filed
   under its tokens and tests the rest of them. Recounting (2), pruning (3: rules looked up by rules) and judging
   pages are the same join.
5. Of the rules that match a page the most confident one decides, then the one with more support, then the first
   by its text. Without any the verdict is ``DEFAULT``.

Edge cases:

* A null url, or one without ``://``, has an empty host and path and no tokens: no rule fits, the verdict is the
  default.
* Several labels of one id: block if any says so. Labels null in both columns are none. Labels without page and pages
  without label take no part in mining. Repeated pages count once for each row.
* No labels, or labels of one class: nothing is mined.
* Pages without id are judged too; repeated rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.places import numbered
from .shared import drop, lower_ascii, written


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
#: Given rules are tested one by one for every page.
MOST_RULES = 1000
DEFAULT = "allow"
#: Share of the labelled URLs, and number of them, that a rule and its class must occur in together.
SUPPORT, LEAST = 0.002, 8
#: Share of a rule's URLs that must be of its class, and standard errors that this is above the base rate.
CONFIDENCE, DEVIATION = 0.5, 3.0


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and the rest of a URL; empty without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    cut = lambda i: F.regexp_extract(after, r"^([^/?#]*)([^?#]*)([\s\S]*)$", i)
    return lower_ascii(cut(1)), cut(2), cut(3)


def tokens(url: Column) -> Column:
    """A URL's distinct tokens: scheme, host labels and their words, path segments with digits as #, extension,
    names of query fields, whether it has a fragment."""
    host, path, rest = (F.lower(p) for p in parts(url))
    scheme = F.lower(F.substring_index(url, "://", 1))
    labels = F.split(host, r"\.")
    segments = F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, "[0-9]+", "#"))
    fields = F.regexp_extract_all(F.regexp_extract(rest, r"^\?([^#]*)", 1), F.lit("(?:^|&)([^=&]+)"), F.lit(1))
    named = lambda kind, values: F.transform(
        F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(kind + "="), v)
    )
    found = F.concat(
        F.array(F.concat(F.lit("scheme="), scheme)),
        named("host", labels),
        named("word", F.flatten(F.transform(labels, lambda v: F.split(v, "[-_]+")))),
        named("path", segments),
        named("ending", F.array(F.regexp_extract(path, r"\.([a-z0-9]+)$", 1))),
        named("field", fields),
        F.when(rest.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    none = F.array().cast("array<string>")
    return F.when(F.instr(url, "://") > 0, F.array_sort(F.array_distinct(found))).otherwise(none)


def given(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The longest given rule that fits, as a struct (length, rule, verdict); null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} given rules")
    kind = "struct<length:int,rule:string,verdict:string>"
    fitting = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(
                F.lit(len(r.host) + len(r.path)).alias("length"),
                F.lit(r.host + r.path).alias("rule"),
                F.lit(r.verdict).alias("verdict"),
            ),
        ).cast(kind)
        for r in rules
    ]
    return F.array_max(F.array(*fitting)) if fitting else F.lit(None).cast(kind)


def matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, rule) for every rule whose items all are in the set: ``sets`` (row, tokens), ``rules`` (rule, items, key).

    ``key`` is the item that a rule is filed under.
    """
    looked = sets.select("row", "tokens", F.explode("tokens").alias("key"))
    found = looked.join(rules.select("rule", "items", "key"), "key")
    return found.where(F.size(F.array_intersect("items", "tokens")) == F.size("items")).select("row", "rule")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, tokens, block) of the pages with a label."""
    said = labels.where("doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL)")
    blocked = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    said = said.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(blocked.cast("int")).alias("block"))
    urls = pages.select("page_id", "url").join(said, "page_id")
    return urls.select(F.monotonically_increasing_id().alias("row"), tokens(F.col("url")).alias("tokens"), "block")


def frequent_sets(own: DataFrame, count: int, telling: float | None, base: float) -> DataFrame:
    """(items): the sets of items that stand, ``count`` times or more, in rows (row, block, rest) of one class; level by level.

    ``rest`` is in order. A set is grown by the later items of each row that has it, and its rows are counted, so that
    nothing is held but tables. With ``telling``, the square of the least deviation, a set is left out if no rule comes
    of it that would be kept: if it has the rows of a smaller set, or all rows of a smaller one are of one class (the smaller
    one is as confident then), or if it were too few rows even with all of one class.
    """
    need = [max(count, 0 if telling is None else telling * r / (1 - r) * (1 - 1e-9)) for r in (base, 1 - base)]
    enough = (F.col("b") >= need[0]) | (F.col("n") - F.col("b") >= need[1])
    none = F.array().cast("array<long>")
    at = written(own.select("row", "block", none.alias("items"), F.transform("rest", lambda i: i.cast("long")).alias("rest")), "rules-rows")
    levels, below = [], None
    while True:
        grown = at.select("row", "block", "items", "rest", F.posexplode("rest").alias("i", "item"))
        later = F.slice("rest", F.col("i") + 2, F.size("rest"))
        grown = grown.select("row", "block", F.concat("items", F.array("item")).alias("items"), later.alias("rest"))
        sets = grown.groupBy("items").agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("b")).where(enough)
        if telling is not None and below is not None:
            whole = F.size("items")
            less = F.transform(F.sequence(F.lit(1), whole), lambda i: F.concat(F.slice("items", 1, i - 1), F.slice("items", i + 1, whole)))
            parts_ = sets.select("items", "n", "b", F.explode(less).alias("less"))
            wider = below.select(F.col("items").alias("less"), F.col("n").alias("m"))
            held = parts_.join(wider, "less").where("n < m").groupBy("items", "n", "b").agg(F.count(F.lit(1)).alias("k"))
            sets = held.where(F.col("k") == whole).drop("k")
        sets = written(sets, "rules-level")
        levels.append(sets)
        below = sets if telling is None else sets.where("b > 0 AND b < n")
        next_ = written(grown.where(F.size("rest") > 0).join(below.select("items"), "items", "left_semi"), "rules-rows")
        drop(at)
        at = next_
        if at.isEmpty():
            break
    drop(at)
    out = levels[0].select("items")
    for level in levels[1:]:
        out = out.unionByName(level.select("items"))
    out = written(out, "rules-frequent")
    drop(*levels)
    return out


def mine(
    seen: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE,
    deviation: float = DEVIATION, widest: int | None = None,
) -> DataFrame | None:
    """(rule, items, key, verdict, n, hits, confidence) from labelled (row, tokens, block); None if nothing can be mined.

    ``rule`` is the text of the items. ``n`` and ``hits`` count all labelled URLs with the items, and those of the class.
    With ``widest`` only so many items of a URL, those that deviate most from the base rate, are combined.
    """
    total, blocked = seen.agg(F.count(F.lit(1)), F.sum("block")).first()
    if not total or not blocked or blocked == total:
        return None
    base = blocked / total
    count = max(least, math.ceil(support * total))
    each = seen.select("row", "block", F.explode("tokens").alias("token"))
    stats = each.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.sum("block").alias("b"), F.bit_xor(F.xxhash64("row")).alias("rows")
    )
    stats = stats.where(F.col("n") >= count).groupBy("n", "b", "rows").agg(F.min("token").alias("token"))
    lean = F.abs(F.col("b") - F.col("n") * base) / F.sqrt(F.col("n"))
    items = numbered(stats.select("token", "n", lean.alias("lean")), "token", into="item")
    items = written(items, "rules-items")
    own = each.join(items, "token").groupBy("row")
    if widest is None:
        own = own.agg(F.max("block").alias("block"), F.sort_array(F.collect_list("item")).alias("rest"))
    else:
        best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("lean")).alias("x"), "token", "item"))), 1, widest)
        own = own.agg(F.max("block").alias("block"), F.sort_array(best["item"]).alias("rest"))
    frequent = frequent_sets(own, count, None if widest is not None else deviation**2, base)
    # filed under the rarest item
    rare = frequent.select("items", F.explode("items").alias("item")).join(items.select("token", "n", "item"), "item")
    rare = rare.groupBy(F.col("items").alias("numbers")).agg(
        F.array_sort(F.collect_list("token")).alias("items"), F.min(F.struct("n", "token"))["token"].alias("key")
    )
    candidates = written(rare.select(F.concat_ws(" ", "items").alias("rule"), "items", "key"), "rules-candidates")
    drop(frequent)
    # exact counts, over all labelled URLs and all their tokens
    counts = matches(seen, candidates).join(seen.select("row", "block"), "row").groupBy("rule")
    counts = candidates.join(counts.agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("b")), "rule")
    both = [
        counts.select("rule", "items", "key", F.lit(v).alias("verdict"), "n", h.alias("hits"), F.lit(r).alias("rate"))
        for v, h, r in (("block", F.col("b"), base), ("allow", F.col("n") - F.col("b"), 1 - base))
    ]
    rules = both[0].unionByName(both[1]).withColumn("confidence", F.col("hits") / F.col("n"))
    above = (F.col("confidence") - F.col("rate")) / F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n"))
    rules = rules.where((F.col("hits") >= count) & (F.col("confidence") >= confidence) & (above >= deviation))
    rules = written(rules.drop("rate"), "rules-kept")
    # a rule is looked up by the more special ones; where one is found that is as confident, the special one goes
    as_sets = rules.select(F.struct("rule", "verdict").alias("row"), F.col("items").alias("tokens"))
    named = rules.select(F.struct("rule", "verdict", "confidence").alias("rule"), "items", "key")
    wider = matches(as_sets, named).where("rule.rule <> row.rule AND rule.verdict = row.verdict")
    wider = wider.groupBy("row.rule", "row.verdict").agg(F.max("rule.confidence").alias("other"))
    kept = rules.join(wider, ["rule", "verdict"], "left").where("other IS NULL OR other < confidence").drop("other")
    out = written(kept.select("rule", "items", "key", "verdict", "n", "hits", "confidence"), "rules")
    drop(items, candidates, rules)
    return out


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined, confidence) of every page; see the module's text.

    ``mined`` is the mined rule that is the first to match, with its confidence, also where a given one decides.
    """
    spread = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = written(labelled(pages, labels).repartition(spread, "row"), "rules-labelled")
    mined = mine(seen)
    host, path, _ = parts(F.col("url"))
    rows = pages.select("page_id", "url").withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "page_id", host.alias("host"), path.alias("path"), tokens(F.col("url")).alias("tokens"))
    rows = rows.withColumn("given", given(F.col("host"), F.col("path"), rules))
    if mined is None:
        none = F.lit(None)
        judged = rows.withColumns({"best": none.cast("struct<verdict:string,rule:string,confidence:double>")})
    else:
        rows = written(rows, "rules-pages")
        filed = mined.select(F.struct("rule", "verdict").alias("rule"), "items", "key")
        hits = matches(rows.select("row", "tokens"), filed).select("row", "rule.rule", "rule.verdict")
        hits = hits.join(mined.select("rule", "verdict", "confidence", "n"), ["rule", "verdict"])
        order = F.struct(-F.col("confidence"), -F.col("n"), "rule", "verdict")
        best = F.min_by(F.struct("verdict", "rule", "confidence"), order)
        judged = rows.join(hits.groupBy("row").agg(best.alias("best")), "row", "left")
    return judged.select(
        "page_id", "host", "path", F.col("given.rule").alias("rule"),
        F.coalesce("given.verdict", "best.verdict", F.lit(DEFAULT)).alias("verdict"),
        F.col("best.rule").alias("mined"), F.col("best.confidence").alias("confidence"),
    )
