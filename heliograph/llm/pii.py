"""Personal data: patterns, and information-theoretic sanitisation of the terms around them.

Everything is a DataFrame expression. Emails, addresses, card and phone numbers are found by pattern and
check. Words near such a value may give it away even when it is gone. For each word t and value e the
corpus says how strongly: p(e | t) is the share of the documents with t in which t stands near e, and
log2(p(e | t) / p(e)) the information gained. A word seen near the same value in ``support`` different
texts and above both disclosure thresholds becomes a further span wherever it stands, in texts without any
value too: removed if p(e | t) reaches ``certain`` for some value, generalised to a placeholder otherwise.

Word counts cover all documents, but only of words that stand near some value; they are summed in each partition
first, so a common word costs one row a partition. A value's documents are only ever counted, never gathered. The
distinct words of all texts meet the telling terms by word, after a filter of at most CELLS broadcast numbers; texts
then meet their terms by hash. Folds over a text's matches run in chunks, so that a text may hold very many.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import GAP, WORD, lower_ascii, written

KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)
CELLS = 1 << 22  # of hashed telling terms, broadcast to drop most other words before they are joined
MOST_TERMS = 500_000  # words near values that are broadcast to count only those; more are joined by shuffle
CHUNK = 256  # matches that one fold goes over
BLOCK, BLOCKS = 1024, 64  # code points of a block of text, and blocks cut from the text at once
BRANCHES = 64  # of each of the two levels above the lists of telling terms of one text

#: Java forms of the four patterns. Possessive repeats keep the stack flat on very long matches, and the
#: look-behind (or the end of the last match) keeps a run without a match from being tried at every
#: character; both leave the leftmost matches as they are.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def located(text: Column, pattern: str) -> Column:
    """array<struct<s,e,v>>: the matches of a pattern with their places in code points.

    The text between matches comes from a split by the same pattern, so lengths add up to places. They are
    added up within chunks of matches, and then over chunks.
    """
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1), lambda m, g: F.struct(F.length(g).alias("g"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("v")))).alias("out"))

    def within(chunk: Column) -> Column:
        return F.aggregate(chunk, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def shifted(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda m: F.struct((m["s"] + acc["at"]).alias("s"), (m["e"] + acc["at"]).alias("e"), m["v"].alias("v")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def whole(found: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(found) / CHUNK).cast("int")), lambda c: within(F.slice(found, c * CHUNK + 1, F.lit(CHUNK))))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,e:int,v:string>>>").alias("out"))
        return F.aggregate(chunks, start, shifted, lambda acc: F.flatten(acc["out"]))

    return once(F.filter(pairs, lambda x: x["m"].isNotNull()), whole)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def _is_card(v: Column) -> Column:
    digits = _digits(v)
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)


def _is_ip(v: Column) -> Column:
    def small(part: Column) -> Column:
        short = F.ltrim(part, F.lit("0"))
        return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))

    return F.forall(F.split(v, r"\."), small)


def base_spans(text: Column) -> Column:
    """array<struct<kind,s,e,v>> of the four kinds, in the order of kinds, then places. Null text: empty."""
    worth_it = {
        "email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"(?:[0-9][\x20-]?){13}"), "phone": F.contains(text, F.lit("+")),
    }
    passes = {"email": lambda v: F.lit(True), "ip": _is_ip, "card": _is_card, "phone": lambda v: F.length(_digits(v)).between(9, 15)}
    none = F.array().cast("array<struct<kind:int,s:int,e:int,v:string>>")

    def named(n: int, kind: str) -> Column:
        good = F.filter(located(text, PATTERNS[kind]), lambda x: passes[kind](x["v"]))
        return F.transform(good, lambda x: F.struct(F.lit(n).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))

    parts = [F.when(worth_it[kind], named(n, kind)).otherwise(none) for n, kind in enumerate(KINDS)]
    return F.coalesce(F.concat(*parts), none)


def blocks(text: Column) -> Column:
    """array<string>: the text in blocks of BLOCK code points, as finding a place in a long string takes its length."""

    def cut_again(part: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda i: F.substring(part, i * BLOCK + 1, F.lit(BLOCK)))

    wide = BLOCK * BLOCKS
    last = F.floor(F.length(text) / wide).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), last), lambda j: once(F.substring(text, j * wide + 1, F.lit(wide)), cut_again)))


def cut(parts: Column, at: Column, end: Column) -> Column:
    """The text of ``blocks`` from ``at`` to ``end``, which lie in it."""

    def block(i: Column) -> Column:
        return F.coalesce(F.try_element_at(parts, i + 1), F.lit(""))

    first, last = F.floor(at / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    inside = F.substring(block(first), at - first * BLOCK + 1, end - at)
    between = F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    over = F.concat(F.substring(block(first), at - first * BLOCK + 1, F.lit(BLOCK)), between, F.substring(block(last), F.lit(1), end - last * BLOCK))
    return F.when(first == last, inside).otherwise(over)


def islands(spans: Column, kind: str) -> Column:
    """array<struct<s,e,members>>: stretches of overlapping spans, in order and apart from each other.

    Members are the rest of their spans, of type struct<kind>, in order.
    """
    names = [x.split(":")[0] for x in kind.split(",")]
    none = F.array().cast(f"array<struct<s:int,e:int,members:array<struct<{kind}>>>>")
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(*[x[c].alias(c) for c in ("s", "e", *names)])))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        own = F.array(F.struct(*[x[c].alias(c) for c in names]))
        grown = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), F.concat(last["members"], own).alias("members"))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))
        alone = F.struct(x["s"].alias("s"), x["e"].alias("e"), own.alias("members"))
        return F.when((F.size(acc) > 0) & (x["s"] < last["e"]), joined).otherwise(F.concat(acc, F.array(alone)))

    return F.aggregate(ordered, none, step)


def context(text: Column, spans: Column, words: int, reach: int) -> Column:
    """array<struct<kind,v,term>>: for each value up to ``words`` words on either side of its island that touch no span.

    ``reach`` code points are looked at on a side; a word cut by that limit does not count. Islands are apart and at
    least five code points long, so those within reach are the next few in order.
    """
    few = reach // 5 + 1

    def moved(found: Column, by: Column) -> Column:
        return F.transform(found, lambda w: F.struct((w["s"] + by).alias("s"), (w["e"] + by).alias("e"), w["v"].alias("v")))

    def around(parts: Column, all_: Column, size: Column, x: Column, i: Column) -> Column:
        low, high = F.greatest(x["s"] - reach, F.lit(0)), F.least(x["e"] + reach, size)
        left = F.filter(once(cut(parts, low, x["s"]), lambda t: located(t, WORD)), lambda w: (w["s"] > 0) | (low == 0))
        left = once(left, lambda found: F.slice(found, F.greatest(F.size(found) - words + 1, F.lit(1)), F.lit(words)))
        right = F.filter(once(cut(parts, x["e"], high), lambda t: located(t, WORD)), lambda w: w["e"] < reach)
        beside = F.slice(all_, F.greatest(i + 1 - few, F.lit(1)), F.lit(2 * few + 1))

        def free(near: Column, others: Column) -> Column:
            return F.filter(near, lambda w: ~F.exists(others, lambda o: (w["s"] < o["e"]) & (o["s"] < w["e"])))

        near = once(F.concat(moved(left, low), moved(F.slice(right, 1, words), x["e"])), lambda n: once(beside, lambda others: free(n, others)))
        terms = F.transform(near, lambda w: lower_ascii(w["v"]))
        return once(terms, lambda t: F.flatten(F.transform(x["members"], lambda m: F.transform(t, lambda w: F.struct(m["kind"].alias("kind"), m["v"].alias("v"), w.alias("term"))))))

    def whole(parts: Column) -> Column:
        found = islands(spans, "kind:int,v:string")
        return once(F.length(text), lambda size: once(found, lambda all_: F.flatten(F.transform(all_, lambda x, i: around(parts, all_, size, x, i)))))

    return once(blocks(text), whole)


def _branches(term: Column) -> tuple[Column, Column]:
    """Two numbers below BRANCHES; maps are searched from the front, so a long list is a map of maps by these."""
    h = F.xxhash64(term)
    return F.pmod(h, F.lit(BRANCHES)).cast("int"), F.pmod(F.shiftright(h, 16), F.lit(BRANCHES)).cast("int")


def listed_terms(told: DataFrame) -> DataFrame:
    """(pii_key, pii_told): the (pii_key, term, removed) rows of each text as maps in maps, see ``_branches``."""
    one, two = _branches(F.col("term"))
    rows = told.select("pii_key", "term", "removed").distinct().withColumns({"one": one, "two": two})

    def put(keys: list[str], at: str, value: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(at, value))).alias("m"))

    rows = put(["pii_key", "one", "two"], "term", "removed")
    rows = put(["pii_key", "one"], "two", "m")
    return put(["pii_key"], "one", "m").withColumnRenamed("m", "pii_told")


def told_spans(text: Column, spans: Column, told: Column) -> Column:
    """array<struct<kind,s,e,removed>>: all words of the text that are in ``told`` (``listed_terms``) and touch no span."""
    none = F.array().cast("array<struct<kind:int,s:int,e:int,removed:boolean>>")

    def span(w: Column) -> Column:
        one, two = _branches(w["v"])
        removed = F.try_element_at(F.try_element_at(F.try_element_at(told, one), two), w["v"])
        return F.struct(F.lit(TERM).alias("kind"), w["s"].alias("s"), w["e"].alias("e"), removed.alias("removed"))

    def free(w: Column) -> Column:
        return w["removed"].isNotNull() & ~F.exists(spans, lambda o: (w["s"] < o["e"]) & (o["s"] < w["e"]))

    found = F.filter(F.transform(located(lower_ascii(text), WORD), span), free)
    return F.when(told.isNotNull(), found).otherwise(none)


def find(docs: DataFrame, keep: list[str], words: int = 4, reach: int = 160, support: int = 3, share: float = 0.5, certain: float = 0.9, bits: float = 6.0, text_col: str = "text") -> DataFrame:
    """(pii_row, pii_spans): every row's columns ``keep`` as a struct, and array<struct<kind,s,e,removed>> in order.

    Kinds 0 to 3 are the base patterns, 4 the added terms. Null and empty texts have no spans. Equal
    texts get equal spans, whatever their ids; repeated rows count as documents.
    """
    text = F.col(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("pii_row"), text.alias("pii_text"), base_spans(text).alias("pii_base"))
    has = F.size("pii_base") > 0
    found = written(rows.where(has).select("pii_base", F.sha2("pii_text", 256).alias("pii_key"), context(F.col("pii_text"), F.col("pii_base"), words, reach).alias("pii_near")), "pii-found")

    near = found.select("pii_key", F.explode("pii_near").alias("n")).select("pii_key", "n.*")
    per_text = near.select("pii_key", "kind", "v", "term").groupBy("pii_key", "kind", "v", "term").agg(F.count(F.lit(1)).alias("times"))
    copies = found.groupBy("pii_key").agg(F.count(F.lit(1)).alias("docs"))
    counted = per_text.join(copies, "pii_key")
    together = counted.groupBy("kind", "v", "term").agg(F.count(F.lit(1)).alias("texts"), F.sum("docs").alias("together")).where(F.col("texts") >= support)
    beside = counted.select("pii_key", "term", "docs").distinct().groupBy("term").agg(F.sum("docs").alias("beside"))  # documents with the word near any value
    values = found.select("pii_key", F.explode(F.array_distinct(F.transform("pii_base", lambda x: F.struct(x["kind"].alias("kind"), x["v"].alias("v"))))).alias("x"))
    values = values.groupBy("x.kind", "x.v").agg(F.count(F.lit(1)).alias("value_docs"))
    total = docs.count()
    base_rate = F.col("value_docs") / F.lit(float(max(total, 1)))
    # a word stands in as many documents at least as it stands near values in: most common words are ruled out before all texts are counted
    at_most = F.col("together") / F.col("beside")
    together = together.join(beside, "term").join(values, ["kind", "v"]).where((at_most >= share) & (F.log2(at_most / base_rate) >= bits))
    together = written(together, "pii-together")
    asked = together.select("term").distinct()
    if asked.count() <= MOST_TERMS:
        asked = F.broadcast(asked)
    terms = docs.select(F.explode(F.array_distinct(F.split(lower_ascii(text), GAP))).alias("term")).join(asked, "term", "left_semi")
    terms = terms.groupBy("term").agg(F.count(F.lit(1)).alias("term_docs"))
    given = F.col("together") / F.col("term_docs")
    telling = together.join(terms, "term").where((given >= share) & (F.log2(given / base_rate) >= bits))
    telling = written(telling.groupBy("term").agg(F.max(given >= certain).alias("removed")), "pii-telling")

    key = F.xxhash64(text)  # texts of one hash share the list; a word must still be in the text to be marked there
    cell = F.pmod(F.xxhash64("term"), F.lit(CELLS)).cast("int")
    cells = telling.select(cell.alias("cell")).distinct()
    words_in = docs.select(key.alias("pii_key"), F.explode(F.array_distinct(F.split(lower_ascii(text), GAP))).alias("term"))
    told = words_in.withColumn("cell", cell).join(F.broadcast(cells), "cell", "left_semi").join(telling, "term")
    told = written(listed_terms(told), "pii-told")
    base = F.transform("pii_base", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(False).alias("removed")))
    whole = F.col("pii_row").getField(text_col) if text_col in keep else F.col("pii_text")
    wordy = F.coalesce(F.length("pii_text") > 0, F.lit(False))
    spread = F.when(wordy, F.xxhash64("pii_text")).otherwise(F.monotonically_increasing_id())  # empty texts would all meet in one task
    met = rows.withColumn("pii_key", spread).join(told, "pii_key", "left")
    return met.select("pii_row", F.concat(base, told_spans(whole, F.col("pii_base"), F.col("pii_told"))).alias("pii_spans"))


def _listed(spans: Column) -> Column:
    name = F.element_at(F.array(*[F.lit(k) for k in (*KINDS, "term")]), spans["kind"] + 1)
    return F.concat_ws(":", name, spans["s"], spans["e"])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts per kind, base_sha256 over the base spans, and all spans as text."""
    found = find(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"])
    base = F.filter("pii_spans", lambda x: x["kind"] < TERM)

    def count(n: int) -> Column:
        return F.size(F.filter("pii_spans", lambda x: x["kind"] == n)).cast("long")

    counts = {f"n_{k}": count(n) for n, k in enumerate((*KINDS, "term"))}
    return found.select("pii_row.doc_id", *[c.alias(k) for k, c in counts.items()], F.sha2(F.array_join(F.transform(base, _listed), ","), 256).alias("base_sha256"), F.array_join(F.transform("pii_spans", _listed), ",").alias("spans"))


def cleaned(text: Column, spans: Column) -> Column:
    """The text with base values and generalised terms as placeholders, and removed terms gone; of overlapping spans the first counts."""

    def label(x: Column) -> Column:
        one = F.element_at(x["members"], 1)
        return reduce(lambda rest, n: F.when(one["kind"] == n, f"[{KINDS[n].upper()}]").otherwise(rest), range(TERM), F.when(one["removed"], "").otherwise("[TERM]"))

    def pieces(parts: Column, all_: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            return F.concat(cut(parts, F.element_at(all_, i)["e"], x["s"]), label(x))

        first = F.when(F.size(all_) > 0, F.concat(cut(parts, F.lit(0), F.element_at(all_, 1)["s"]), label(F.element_at(all_, 1))))
        rest = F.transform(F.slice(all_, F.lit(2), F.size(all_)), lambda x, i: piece(x, i + 1))
        tail = cut(parts, F.element_at(all_, -1)["e"], F.length(text))
        return F.concat(first, F.array_join(rest, ""), tail)

    done = once(blocks(text), lambda parts: once(islands(spans, "kind:int,removed:boolean"), lambda all_: pieces(parts, all_)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, the text cleaned and n_chars (if there) counted anew. No row goes."""
    found = find(docs, docs.columns, text_col=text_col)

    def column(name: str) -> Column:
        return F.col("pii_row").getField(name)

    def value(name: str) -> Column:
        clean = cleaned(column(text_col), F.col("pii_spans"))
        if name == text_col:
            return clean
        if name == "n_chars" and text_col == "text":
            return F.when(column(text_col).isNull(), column(name)).otherwise(F.length(clean)).cast(docs.schema[name].dataType)
        return column(name)

    return found.select(*[value(c).alias(c) for c in docs.columns])
