"""Information-theoretic sanitisation of personal data, with column expressions only.

Protected entities are the values of patterns: e-mail and IP addresses, card and phone numbers. What else in a text
gives an entity away is estimated from the corpus. For an entity c in n_c distinct texts and a term t in n_t, of N texts,
of which n_ct have t in the context of c, the mutual information of both is log(n_ct * N / (n_c * n_t)), and the entity's own
information is log(N / n_c). Their ratio is the share of c that t discloses: 1 if t is only ever seen beside c. A
term with a ratio of ``GENERALISE`` or more is replaced by its class, one with ``REMOVE`` or more is taken out, in the contexts
of that entity. A pair counts only with ``SUPPORT`` distinct texts, so that chance and copies of one text prove nothing.

A context is up to ``WIDTH`` code points on either side of a pattern's match, up to the next match. So pairs of
entities and terms grow with the matches, not with the product of both. Copies are one text in all counts: a
text's digest stands for it. Counts are pre-aggregated and stored, so joins with them can split an entity that very many rows name.

Patterns are written so that no text needs more than linear time: they start where a run of their characters
starts, and possessive quantifiers take whole runs. A match's place is the length of what ``split`` leaves before it.

Defined results: a null text is empty and has no spans. Spans count code points, end exclusive; matches that fail their check are
dropped without a new try. Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; one
that touches the edge of a context cut by its width is not looked at. Texts that name no entity have no spans. Very long texts are
scanned whole. Repeated rows are judged alike, row by row; null and repeated doc_ids do not matter, as rows have a key of
their own. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuesheet.plans.session import stage

KINDS = ("email", "ip", "card", "phone", "term")
WIDTH, SUPPORT = 64, 3
GENERALISE, REMOVE = 0.75, 0.9
#: Candidate terms and digests of copied texts are sent to all tasks up to so many; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

_LOCAL = r"A-Za-z0-9._%+-"
_PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    # chains of fewer than 12 digits fail their check in any case
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SPAN = "struct<start: int, kind: int, end: int, value: string>"
#: Prefix sums of an array are taken in blocks of this many.
_BLOCK = 128


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return (F.length(digits) <= 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    """One spelling for all ways to write a value."""
    if kind in ("card", "phone"):
        return F.regexp_replace(value, "[^0-9]", "")
    return F.translate(value, UPPER, LOWER)


def _named(item: str) -> Column:
    """The entity of a span column."""
    return F.coalesce(*[F.when(F.col(f"{item}.kind") == n, _entity(kind, F.col(f"{item}.value"))) for n, kind in enumerate(KINDS[:4])])


def _matches(df: DataFrame, kind: str) -> DataFrame:
    """Add array column ``kind`` of the valid matches, in order. ``text`` is not null."""
    pattern = _PATTERNS[kind]
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    hint = {"email": "@", "phone": "+"}.get(kind)
    if hint:
        found = F.when(F.contains("text", F.lit(hint)), found).otherwise(F.expr("cast(array() as array<string>)"))
    df = df.withColumn("values", found)
    pieces = F.when(F.size("values") > 0, F.split("text", pattern, -1)).otherwise(F.expr("cast(array() as array<string>)"))
    # the piece before each match, and the match
    df = df.withColumn("pieces", pieces)
    df = df.withColumn("steps", F.expr("""transform(slice(arrays_zip(values, pieces), 1, size(values)), z ->
        named_struct('value', z.values, 'size', char_length(z.values), 'step', char_length(z.pieces) + char_length(z.values)))"""))
    df = df.withColumn("sums", F.expr(f"""transform(sequence(0, size(steps) div {_BLOCK}), b ->
        aggregate(slice(steps, b * {_BLOCK} + 1, {_BLOCK}), 0, (a, s) -> a + s.step))"""))
    df = df.withColumn("heads", F.expr("transform(sums, (x, b) -> aggregate(slice(sums, 1, b), 0, (a, s) -> a + s))"))
    df = df.withColumn("placed", F.expr(f"""transform(steps, (s, i) -> named_struct('value', s.value, 'size', s.size, 'end',
        heads[i div {_BLOCK}] + aggregate(slice(steps, i div {_BLOCK} * {_BLOCK} + 1, i % {_BLOCK} + 1), 0, (a, x) -> a + x.step)))"""))
    spans = F.transform("placed", lambda p: F.struct(
        (p["end"] - p["size"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), p["end"].alias("end"), p["value"].alias("value")))
    return df.withColumn(kind, F.filter(spans, lambda s: _valid(kind, s["value"]))).drop("values", "pieces", "steps", "sums", "heads", "placed")


def base_spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, digest, base, runs) of (row, doc_id, text): the pattern matches by start and kind, and runs of touching ones with
    their contexts. digest, 16 bytes, stands for the text; it is null for an empty one."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    for kind in KINDS[:4]:
        df = _matches(df, kind)
    df = df.withColumn("base", F.array_sort(F.concat(*KINDS[:4]))).drop(*KINDS[:4])
    none = f"cast(array() as array<{_SPAN}>)"
    closed = "concat(a.runs, array(named_struct('first', a.first, 'after', a.after, 'items', a.items)))"
    df = df.withColumn("joined", F.expr(f"""
        aggregate(base,
          named_struct('runs', cast(array() as array<struct<first: int, after: int, items: array<{_SPAN}>>>), 'first', -1, 'after', -1, 'items', {none}),
          (a, x) -> if(x.start <= a.after,
            named_struct('runs', a.runs, 'first', a.first, 'after', greatest(a.after, x.end), 'items', concat(a.items, array(x))),
            named_struct('runs', if(a.after >= 0, {closed}, a.runs), 'first', x.start, 'after', x.end, 'items', array(x))),
          a -> if(a.after >= 0, {closed}, a.runs))"""))
    df = df.withColumn("n_chars", F.char_length("text"))
    df = df.withColumn("edges", F.expr(f"""transform(joined, (r, i) -> named_struct('items', r.items,
        'first', r.first, 'after', r.after,
        'low', greatest(if(i > 0, joined[i - 1].after, 0), r.first - {WIDTH}), 'low_cut', r.first - {WIDTH} > if(i > 0, joined[i - 1].after, 0),
        'high', least(if(i + 1 < size(joined), joined[i + 1].first, n_chars), r.after + {WIDTH}),
        'high_cut', r.after + {WIDTH} < if(i + 1 < size(joined), joined[i + 1].first, n_chars)))"""))
    runs = F.expr("""transform(edges, e -> named_struct('items', e.items, 'contexts', array(
        named_struct('at', e.low, 'text', substring(text, e.low + 1, e.first - e.low), 'low_cut', e.low_cut, 'high_cut', false),
        named_struct('at', e.after, 'text', substring(text, e.after + 1, e.high - e.after), 'low_cut', false, 'high_cut', e.high_cut))))""")
    return df.select("row", "doc_id", F.when(F.col("text") != "", _digest(F.col("text"))).alias("digest"), "base", runs.alias("runs"))


def _digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _terms(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(row, digest, kind, entity, term, start, end): the terms in the contexts of the given entities."""
    runs = found.filter(F.size("runs") > 0).select("row", "digest", F.explode("runs").alias("run"))
    mentions = runs.select("row", "digest", F.explode("run.items").alias("item"), F.col("run.contexts").alias("contexts")).select(
        "row", "digest", F.col("item.kind").alias("kind"), _named("item").alias("entity"), "contexts")
    kept = mentions.join(entities.select("kind", "entity"), ["kind", "entity"])
    contexts = kept.select("row", "digest", "kind", "entity", F.explode("contexts").alias("c")).select(
        "row", "digest", "kind", "entity", "c.at", "c.text", "c.low_cut", "c.high_cut")
    words = contexts.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("gaps", F.split("text", WORD, -1))
    # a context is short, so sums from its start are cheap
    words = words.withColumn("steps", F.expr("slice(arrays_zip(words, gaps), 1, size(words))"))
    placed = words.withColumn("placed", F.expr("""transform(steps, (s, i) -> named_struct('word', s.words, 'end',
        aggregate(slice(steps, 1, i + 1), 0, (a, x) -> a + char_length(x.gaps) + char_length(x.words))))"""))
    each = placed.select("row", "digest", "kind", "entity", "at", "low_cut", "high_cut", F.char_length("text").alias("width"), F.explode("placed").alias("p"))
    size = F.char_length("p.word")
    whole = ~(F.col("low_cut") & (F.col("p.end") == size)) & ~(F.col("high_cut") & (F.col("p.end") == F.col("width")))
    return each.filter(whole).select(
        "row", "digest", "kind", "entity", _lower(F.col("p.word")).alias("term"),
        (F.col("at") + F.col("p.end") - size).alias("start"), (F.col("at") + F.col("p.end")).alias("end"))


def _sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _text_counts(docs: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, n_t): the distinct texts of the corpus that hold each wanted term."""
    texts = docs.filter("text <> ''").select("text", _digest(F.col("text")).alias("digest"))
    copied = _sent(stage(found.filter("digest is not null").groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "copied"))
    wanted = _sent(wanted)

    def terms(df: DataFrame) -> DataFrame:
        words = F.array_distinct(F.regexp_extract_all(_lower(F.col("text")), F.lit(WORD), F.lit(0)))
        return df.select("digest", F.explode(words).alias("term")).join(wanted, "term", "left_semi")

    single = terms(texts.join(copied, "digest", "left_anti")).groupBy("term").agg(F.count("*").alias("n"))
    several = terms(texts.join(copied, "digest", "left_semi")).distinct().groupBy("term").agg(F.count("*").alias("n"))
    return single.unionByName(several).groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosures(docs: DataFrame, found: DataFrame, terms: DataFrame, entities: DataFrame, support: int, generalise: float) -> DataFrame:
    """(kind, entity, term, n_ct, n_c, n_t, share) of the pairs that disclose at least the share ``generalise``."""
    total = found.filter("digest is not null").agg(F.count_distinct("digest").alias("n"))
    pairs = stage(terms.select("kind", "entity", "term", "digest").distinct().groupBy("kind", "entity", "term").agg(
        F.count("*").alias("n_ct")).filter(F.col("n_ct") >= support), "pairs")
    counts = stage(_text_counts(docs, found, pairs.select("term").distinct()), "terms")
    n = total.scalar()
    share = F.log(F.col("n_ct") * n / (F.col("n_c") * F.col("n_t"))) / F.log(n / F.col("n_c"))
    rated = pairs.join(entities, ["kind", "entity"]).join(counts, "term").filter(F.col("n_c") < n).withColumn("share", share)
    return rated.filter(F.col("share") >= generalise)


def _judged(rows: DataFrame, support: int, generalise: float, remove: float) -> DataFrame:
    """(row, doc_id, found) of (row, doc_id, text)."""
    found = stage(base_spans(rows), "found")
    values = found.filter(F.size("base") > 0).select("digest", F.explode("base").alias("b"))
    entities = stage(values.select(F.col("b.kind").alias("kind"), _named("b").alias("entity"), "digest").distinct().groupBy("kind", "entity").agg(
        F.count("*").alias("n_c")).filter(F.col("n_c") >= support), "entities")
    terms = stage(_terms(found, entities), "contexts")
    shares = stage(disclosures(rows, found, terms, entities, support, generalise), "shares").select("kind", "entity", "term", "share")
    spans = terms.join(shares, ["kind", "entity", "term"]).groupBy("row", "start", "end", "term").agg(F.max("share").alias("share"))
    extra = spans.groupBy("row").agg(F.collect_list(F.struct(
        "start", F.lit(4).alias("kind"), "end", F.col("term").alias("value"), F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("action"))).alias("extra"))
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), b["value"].alias("value"), F.lit("mask").alias("action")))
    everything = F.when(F.col("extra").isNull(), base).otherwise(F.array_sort(F.concat(base, "extra")))
    joined = found.select("row", "doc_id", "base").join(stage(extra, "extra"), "row", "left").select("row", "doc_id", everything.alias("spans"))
    names = F.array(*map(F.lit, KINDS))
    return joined.select("row", "doc_id", F.transform("spans", lambda s: F.struct(
        F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"),
        s["value"].alias("value"), s["action"].alias("action"))).alias("found"))


def find_personal_data(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(doc_id, found) of each row: array<struct<kind, start, end, value, action>> by start, then kind as listed."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return _judged(rows, support, generalise, remove).select("doc_id", "found")


def sanitise_documents(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """All rows and columns, with ``text`` sanitised: matches masked by kind, terms generalised to [NUMBER] or [WORD] or taken out. Of
    overlapping spans the first one's replacement stands for all."""
    key = "row"
    while key.lower() in (c.lower() for c in docs.columns):
        key += "_"
    rows = stage(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    found = _judged(rows.select(F.col(key).alias("row"), "doc_id", "text"), support, generalise, remove)
    found = stage(found.filter(F.size("found") > 0).select(F.col("row").alias(key), F.col("found").alias("__found")), "spans")
    new = F.create_map(*[F.lit(x) for pair in MASKS.items() for x in pair])
    label = lambda s: F.when(s["action"] == "mask", new[s["kind"]]).when(s["action"] == "remove", "").when(s["value"].rlike("^[0-9]+$"), "[NUMBER]").otherwise("[WORD]")
    marked = rows.join(found, key, "left").withColumn("__found", F.transform("__found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label"))))
    runs = F.expr("""aggregate(__found, named_struct('runs', cast(array() as array<struct<start: bigint, end: bigint, label: string>>), 'after', 0L),
        (a, x) -> if(x.start < a.after,
            named_struct('runs', concat(slice(a.runs, 1, size(a.runs) - 1), array(named_struct(
                'start', element_at(a.runs, -1).start, 'end', greatest(a.after, x.end), 'label', element_at(a.runs, -1).label))), 'after', greatest(a.after, x.end)),
            named_struct('runs', concat(a.runs, array(x)), 'after', x.end)), a -> a.runs)""")
    marked = marked.withColumn("__found", runs)
    parts = F.expr("""concat(transform(__found, (x, i) -> concat(substring(text, cast(if(i > 0, __found[i - 1].end, 0) + 1 as int),
        cast(x.start - if(i > 0, __found[i - 1].end, 0) as int)), x.label)), array(substring(text, cast(element_at(__found, -1).end + 1 as int))))""")
    return marked.withColumn("text", F.when(F.col("__found").isNull(), F.col("text")).otherwise(F.array_join(parts, ""))).select(*docs.columns)


def personal_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the span lists of the contract."""
    def listed(condition=None):
        spans = F.filter("found", condition) if condition else F.col("found")
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS[:4]), F.sha2(listed(lambda s: s["kind"] != "term").cast("binary"), 256).alias("base_sha256"), listed().alias("spans"))
