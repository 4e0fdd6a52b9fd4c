"""Personal data: pattern spans and terms that give protected entities away, DataFrame functions only.

Base spans come from four patterns.  Every base span is a protected entity.  Terms are
letter or digit runs.  Over the whole corpus a term's disclosure of an entity is P(entity | term),
the share of its occurrences that lie in documents with the entity, and the information that this
gives, log2 of that share over the share of documents with the entity.  Terms beyond both
thresholds, seen with the entity in at least ``MIN_CONTEXTS`` different contexts (neighbouring terms,
so copies count once), are found in every text and generalised (``[TERM]``).  Only terms that pass
for all entities together are paired with single entities, so documents with many of
both give no product.  A term that carries its information by its spelling alone, a long run in which
letters and digits take turns (a key, a token), is a secret, however rare it is.

Positions are code points.  ``split`` gives what lies between a pattern's matches and
``regexp_extract_all`` the matches, so running sums of lengths give the spans.  Patterns
start behind a look-behind or where the last match ended, so no start is tried twice in a
long run and every match is the leftmost one; repetitions of groups are bounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkmill.llm.common import materialise, stored

MIN_CONTEXTS = 3
MIN_SHARE = 0.5
MIN_BITS = 3.0
#: Tables of at most so many bytes are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 2 << 20
#: Code points of the pieces that a text is cut into, so that a span is cut out without counting from the text's start.
CHUNK = 1024
#: Changes between a letter and a digit that make a run of ``SECRET`` a secret.
SECRET_TURNS = 4

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A run of digits with single gaps, whole: 14 to 19 digits. Other runs fail anyway.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]+"
SECRET = "(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+"
#: Kinds in the order of spans with one start.
ALL_KINDS = (*KINDS, "term", "secret")
EMPTY = "array<struct<start:bigint,kind_no:int,end:bigint,match:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Luhn's check over the digits of a match."""
    digits = F.split(F.reverse(_digits(match)), "")
    total = F.aggregate(
        F.transform(digits, lambda d, i: F.struct((d.cast("int") * (1 + i % 2)).alias("v"))),
        F.lit(0),
        lambda a, x: a + F.when(x["v"] > 9, x["v"] - 9).otherwise(x["v"]),
    )
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"\A{part}(?:\.{part}){{3}}\z")
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.char_length(_digits(match)).between(10, 15)
    return F.lit(True)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scanned(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative ``join`` over an array: every pass joins what lies twice as far, so n values take n log n steps."""
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def once(a: Column, k: Column) -> Column:
        def back(x: Column, i: Column) -> Column:
            other = F.get(a, i - F.call_function("shiftleft", F.lit(1), k))
            return F.when(other.isNull(), x).otherwise(join(other, x))

        return F.transform(a, back)

    return F.aggregate(passes, values, once)


def spans(text: Column, pattern: Column, kind: str) -> Column:
    """Array of ``(start, kind_no, end, match)`` of a pattern's matches in a text."""
    number = ALL_KINDS.index(kind)

    def placed(parts: Column) -> Column:
        sizes = F.zip_with(parts["found"], F.slice(parts["between"], F.lit(1), F.size(parts["found"])), lambda m, g: (F.char_length(m) + F.char_length(g)).cast("long"))
        return bound(sizes, lambda z: F.zip_with(parts["found"], scanned(z, lambda a, b: a + b), lambda m, end: F.struct(
            (end - F.char_length(m)).alias("start"), F.lit(number).alias("kind_no"), end.alias("end"), m.alias("match"))))

    parts = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return bound(parts, placed).cast(EMPTY)


def base_spans(text: Column) -> Column:
    """Valid base spans of a text by start, then kind."""
    hints = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    digits = text.rlike("[0-9]")
    none = F.array().cast(EMPTY)

    def of(kind: str) -> Column:
        found = F.filter(spans(text, F.lit(PATTERNS[kind]), kind), lambda s: _valid(kind, s["match"]))
        return F.when(hints.get(kind, digits), found).otherwise(none)

    each = [of(kind) for kind in KINDS]
    return F.array_sort(F.concat(*each))


def _named(s: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))


def _entity(s: Column) -> Column:
    """What is protected: the match in lower case, numbers without their gaps."""
    return F.when(s["kind_no"] >= 2, _digits(s["match"])).otherwise(F.lower(s["match"]))


def clear(found: Column, of: Column) -> Column:
    """The spans of ``found``, which do not overlap each other, that overlap none of ``of``.

    All lie in one order, a span of ``found`` where it ends and one of ``of`` where it starts; what starts before an end reaches
    over the span's start if the furthest end so far does.
    """
    mine = F.transform(found, lambda t: F.struct(t["end"].alias("at"), F.lit(0).alias("is_other"), t.alias("span")))
    others = F.transform(of, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("is_other"), b.alias("span")))

    def kept(order: Column) -> Column:
        reach = scanned(F.transform(order, lambda e: F.when(e["is_other"] == 1, e["span"]["end"]).otherwise(F.lit(0).cast("long"))), F.greatest)
        told = F.zip_with(order, reach, lambda e, r: F.struct(e["span"].alias("span"), ((e["is_other"] == 0) & (r <= e["span"]["start"])).alias("keep")))
        return F.transform(F.filter(told, lambda x: x["keep"]), lambda x: x["span"])

    alone = (F.size(found) == 0) | (F.size(of) == 0)
    return F.when(alone, found).otherwise(bound(F.array_sort(F.concat(mine, others)), kept))


def between(chunks: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to before ``end`` of a text that lies in pieces of ``CHUNK``."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    head = F.get(chunks, first)
    own = F.substring(head, (start % CHUNK + 1).cast("int"), (end - start).cast("int"))
    inner = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.coalesce(F.left(F.get(chunks, last), (end % CHUNK).cast("int")), F.lit(""))
    return F.when(end <= start, "").when(first == last, own).otherwise(F.concat(F.substring(head, (start % CHUNK + 1).cast("int"), F.lit(CHUNK)), inner, tail))


def sanitised(text: Column, every: Column, names: Column) -> Column:
    """A text with each span, in order, replaced by its kind's name; overlapping spans become one, named by the first."""

    def built(parts: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(parts["reach"], i - 1), F.lit(0).cast("long"))
            return F.when(s["start"] >= before, F.concat(between(parts["chunks"], before, s["start"]), F.element_at(names, s["kind_no"] + 1)))

        rest = between(parts["chunks"], F.element_at(parts["reach"], -1), F.char_length(text).cast("long"))
        return F.concat(F.array_join(F.transform(every, piece), ""), rest)

    reach = scanned(F.transform(every, lambda s: s["end"]), F.greatest).alias("reach")
    chunks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks")
    return F.when(F.size(every) == 0, text).otherwise(bound(F.struct(reach, chunks), built))


def _small(frame: DataFrame) -> tuple[DataFrame, int]:
    """A materialised table, marked for broadcast if it is within the bound, and its number of rows."""
    size = frame.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
    return (F.broadcast(frame) if (size["bytes"] or 0) <= BROADCAST_BYTES else frame), size["n"]


def disclosing_terms(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``term`` for the terms that disclose an entity; see the module's docstring.

    ``texts``: ``text``; ``found``: ``text`` and ``base`` of the rows with a base span.
    """
    found = found.withColumn("row", F.xxhash64("text"))
    entities = found.select("row", F.explode("base").alias("s")).select("row", _entity(F.col("s")).alias("entity")).distinct()
    runs = found.select("row", F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)).alias("runs"))
    place = F.transform(
        "runs", lambda t, n: F.struct(t.alias("term"), F.xxhash64(*[F.coalesce(F.get("runs", k), F.lit("")) for k in (n - 1, n + 1)]).alias("context"))
    )
    met = runs.select("row", F.explode(place).alias("p")).select("row", "p.term", "p.context")
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("term"))
    words = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    wide = met.groupBy("term").agg(F.count_distinct("context").alias("contexts"), F.count(F.lit(1)).alias("n_met"))
    wide = wide.where(F.col("contexts") >= MIN_CONTEXTS).join(words, "term").where(F.col("n_met") >= MIN_SHARE * F.col("n_term"))
    wide, _ = _small(materialise(wide.select("term", "n_term")))
    pairs = met.join(wide, "term").join(entities, "row").where(~F.contains("entity", F.col("term")))
    pairs = pairs.groupBy("entity", "term").agg(
        F.count_distinct("context").alias("contexts"), F.count(F.lit(1)).alias("n_both"), F.max("n_term").alias("n_term")
    )
    n_entity = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    share = F.col("n_both") / F.col("n_term")
    pairs = pairs.where((F.col("contexts") >= MIN_CONTEXTS) & (share >= MIN_SHARE)).join(n_entity, "entity")
    bits = F.log2(share * F.lit(float(max(texts.count(), 1))) / F.col("n_entity"))
    return pairs.where(bits >= MIN_BITS).select("term").distinct()


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", real: bool = False) -> DataFrame:
    """Counts and spans of personal data per row; with ``real`` also ``sanitised``, the text with
    every span replaced by its kind in brackets.  Counts are those of base kinds, terms and secrets.

    Null texts count as empty.  Base spans of different kinds may overlap and all stay; a term or secret
    that overlaps a base span is left out, and a term that is a secret.  In ``sanitised`` overlapping spans become one, named
    by the first.  The same text has the same spans wherever it stands; an empty table gives an
    empty result; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = rows.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    found = stored(marked.where(F.size("base") > 0).select("text", "base"))
    terms = materialise(disclosing_terms(rows.select("text"), found))
    keys = [F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2")]
    runs = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    terms, n_terms = _small(terms)
    out = marked.select("*", *keys)
    if n_terms:
        hits = rows.select(*keys, F.explode(runs).alias("term")).join(terms, "term")
        hits, _ = _small(materialise(hits.groupBy("h1", "h2").agg(F.collect_set("term").alias("terms"))))
        out = out.join(hits, ["h1", "h2"], "left")
    else:
        out = out.withColumn("terms", F.lit(None).cast("array<string>"))
    quoted = F.array_join(F.transform(F.array_sort("terms"), lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), quoted, F.lit(r")(?![\p{L}\p{N}])"))
    extra = F.when(F.col("terms").isNotNull(), spans(F.col("text"), pattern, "term"))
    extra = F.coalesce(extra, F.array().cast(EMPTY))
    turns = F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]")
    secrets = F.filter(spans(F.col("text"), F.lit(SECRET), "secret"), lambda s: F.regexp_count(s["match"], turns) >= SECRET_TURNS)
    secrets = F.when(F.col("text").rlike("[A-Za-z0-9]{20}"), secrets).otherwise(F.array().cast(EMPTY))

    out = out.withColumn("secrets", clear(secrets, F.col("base"))).withColumn("sure", F.concat("base", "secrets"))
    out = out.withColumn("found", clear(extra, F.col("sure")))
    out = out.withColumn("every", F.array_sort(F.concat("sure", "found")))

    def count(n: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind_no"] == n)).cast("long").alias(f"n_{KINDS[n]}")

    columns = [
        "doc_id", *[count(n) for n in range(len(KINDS))],
        F.size("found").cast("long").alias("n_term"), F.size("secrets").cast("long").alias("n_secret"),
        F.sha2(F.array_join(F.transform("base", _named), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("every", _named), ",").alias("spans"),
    ]
    if real:
        names = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])
        columns.append(sanitised(F.col("text"), F.col("every"), names).alias("sanitised"))
    return out.select(*columns)
