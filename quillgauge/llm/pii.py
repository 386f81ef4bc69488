"""Personal data and what gives it away, in DataFrame and SQL functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers. The information-theoretic
part asks which other terms of a document disclose such an entity: over the whole corpus it counts
in how many distinct texts a term stands near the entity, n(t, e), in how many the entity occurs, n(e),
and in how many the term occurs anywhere, n(t). The term's pointwise mutual information with the
entity, as a share of the entity's own information, is

    log(N n(t, e) / (n(t) n(e))) / log(N / n(e))

where n(t, e) / n(e) is not the plain ratio but the lower end of its Wilson interval, so that an
entity of one or two documents is scored too, with the caution that so few ask for. A term of at
least ``share`` discloses the entity and gets a span in every document that mentions it.
Documents without an entity are left as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgauge.llm.distinct import if_small, is_small, one_of_each
from quillgauge.llm.names import fresh, quoted
from quillgauge.session import materialize

#: Kinds in their order, and the patterns (fixed values). What follows a possessive quantifier can
#: never be in its class, so it matches the same and stays linear; \G or no such character before
#: is where a leftmost match of a run must begin.
_LOCAL = "A-Za-z0-9._%+-"
KINDS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
_QUICK = {"email": "@", "ip": ".", "card": None, "phone": "+"}
NEAR = 80
BLOCK = 64
_WORD_BREAK = r"[^\p{L}]+"
SPAN = "array<struct<start: int, rank: int, end: int, kind: string, value: string>>"
#: One-sided 90 percent: how far the Wilson interval goes below n(t, e) / n(e).
SURE = 1.2816


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def running(items: str, value: str, merge: str, first: str = "0") -> str:
    """SQL for (at, x) of every item x, in order: ``at`` merges ``first`` and ``value`` of the items before.

    ``value`` is SQL over x, ``merge`` over a and v. Items are walked in blocks of 64 and those in blocks of
    64, so an array that grows by a copy stays short and the whole is linear but for one copy in 4,096 items.
    """

    def blocks(of: str, summed: str) -> str:
        total = f"aggregate(x, {first}, (a, y) -> transform(array({summed}), v -> {merge})[0])"
        cut = f"transform(sequence(0, (size(r) - 1) div {BLOCK}), i -> slice(r, i * {BLOCK} + 1, {BLOCK}))"
        cut = f"if(size(r) = 0, slice(array(r), 1, 0), {cut})"
        return f"transform(array({of}), r -> transform({cut}, x -> named_struct('rows', x, 'value', {total})))[0]"

    def walk(of: str, at: str, summed: str, row: str) -> str:
        none = f"transform(slice(w, 1, 0), y -> named_struct('at', {first}, 'x', {row}))"
        merged = f"transform(array({summed}), v -> transform(array(s.at), a -> {merge})[0])[0]"
        step = f"named_struct('at', {merged}, 'out', concat(s.out, array(named_struct('at', s.at, 'x', {row}))))"
        return f"transform(array({of}), w -> aggregate(w, named_struct('at', {at}, 'out', {none}), (s, y) -> {step}, s -> s.out))[0]"

    own = re.sub(r"\bx\b", "y", value)
    inner = blocks(items, own)
    top = walk(blocks(inner, "y.value"), first, "y.value", "y.rows")
    middle = f"flatten(transform({top}, o -> {walk('o.x', 'o.at', 'y.value', 'y.rows')}))"
    return f"flatten(transform({middle}, o -> {walk('o.x', 'o.at', own, 'y')}))"


def located(text: str, pattern: str, kind: str, rank: int) -> str:
    """SQL for all matches with their places: what lies between matches gives the lengths before."""
    items = f"""zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), (g, f) ->
        named_struct('gap', length(g), 'step', length(g) + coalesce(length(f), 0), 'value', f))"""
    return f"""transform(filter({running(items, 'x.step', 'a + v')}, m -> m.x.value is not null), m -> named_struct(
        'start', m.at + m.x.gap, 'rank', {rank}, 'end', m.at + m.x.step, 'kind', '{kind}', 'value', m.x.value))"""


def _chunks(text: str) -> str:
    """SQL for the text in pieces of ``NEAR`` code points: places in them cost the same anywhere in the text."""
    return f"regexp_extract_all({text}, '(?s).{{1,{NEAR}}}', 0)"


def _piece(start: str, end: str) -> str:
    """SQL for the code points [start, end) of the text whose chunks are ``c``."""
    n = NEAR
    return f"""if({end} <= {start}, '', if({start} div {n} = ({end} - 1) div {n},
        substring(get(c, {start} div {n}), {start} % {n} + 1, {end} - {start}),
        concat(substring(get(c, {start} div {n}), {start} % {n} + 1),
            array_join(slice(c, {start} div {n} + 2, ({end} - 1) div {n} - {start} div {n} - 1), ''),
            substring(get(c, ({end} - 1) div {n}), 1, ({end} - 1) % {n} + 1))))"""


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``value``, computed once, under ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _valid(kind: str) -> str:
    """SQL predicate on a match ``x.value``."""
    if kind == "ip":
        return "forall(split(x.value, '\\\\.'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)"
    if kind == "phone":
        return "length(regexp_replace(x.value, '[^0-9]', '')) between 9 and 15"
    if kind == "card":
        digits = "regexp_replace(x.value, '[^0-9]', '')"
        luhn = f"""aggregate(transform(split(reverse({digits}), ''), (c, i) ->
            if(i % 2 = 0, cast(c as int), element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(c as int) + 1))), 0, (a, v) -> a + v) % 10 = 0"""
        return f"if(length({digits}) between 12 and 19, {luhn}, false)"
    return "true"


def base_spans(text: str) -> Column:
    """All valid base spans of a text column, by start and then by kind."""
    empty = f"cast(array() as {SPAN})"
    parts = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        quick = _QUICK[kind]
        test = f"instr({text}, '{quick}') > 0" if quick else "true"
        if kind != "email":
            test += f" and {text} rlike '[0-9]'"
        found = located(text, _literal(pattern), kind, rank)
        parts.append(f"if({test}, filter({found}, x -> {_valid(kind)}), {empty})")
    return F.expr(f"array_sort(concat({', '.join(parts)}))")


def joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def _near_terms() -> Column:
    """(entity, terms near it) of every span, from the text with the base spans blanked out."""
    before = _piece("greatest(0, s.start - {0})".format(NEAR), "s.start")
    after = _piece("s.end", "least(n, s.end + {0})".format(NEAR))
    around = f"regexp_replace(concat({before}, ' ', {after}), '[0-9@]+[^ ]*|[^ ]*@[^ ]*', ' ')"
    terms = f"array_distinct(filter(split(lower({around}), {_literal(_WORD_BREAK)}), t -> length(t) >= 3))"
    found = f"transform(_base, s -> named_struct('entity', lower(concat(s.kind, ':', s.value)), 'terms', {terms}))"
    return F.expr(f"transform(array(named_struct('c', {_chunks('_body')}, 'n', length(_body))), k -> {_let('c', 'k.c', _let('n', 'k.n', found))})[0]")


def lower_bound(hits: Column, of: Column, z: float = SURE) -> Column:
    """Lower end of the Wilson interval of ``hits / of``."""
    p = hits / of
    return (p + z * z / (2 * of) - z * F.sqrt(p * (1 - p) / of + z * z / (4 * of * of))) / (1 + z * z / of)


def disclosing_terms(found: DataFrame, docs_words: DataFrame, share: float) -> DataFrame:
    """(entity, term): terms that disclose an entity, by counts over all distinct texts.

    ``found`` has the distinct texts with a base span (_key, _body, _base), ``docs_words`` the
    distinct texts of all documents (_body), so that all counts are of the same population.
    """
    near = found.select(_near_terms().alias("_near"))
    n_entity = near.select(F.explode(F.expr("array_distinct(_near.entity)")).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    pairs = F.expr("array_distinct(flatten(transform(_near, x -> transform(x.terms, t -> struct(x.entity as entity, t as term)))))")
    together = near.select(F.explode(pairs).alias("x")).groupBy("x.entity", "x.term").agg(F.count(F.lit(1)).alias("n_te"))
    n_entity = materialize(n_entity)
    together = materialize(together.join(if_small(n_entity), "entity"))
    candidates = materialize(together.select("term").distinct())
    if candidates.isEmpty():
        return together.select("entity", "term")
    words = docs_words.select(F.explode(F.array_distinct(F.split(F.lower("_body"), _WORD_BREAK))).alias("term"))
    if is_small(candidates):
        n_term = words.join(F.broadcast(candidates), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    else:
        n_term = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(candidates, "term")
    total = docs_words.agg(F.count(F.lit(1)).cast("double").alias("n_all"))
    scored = together.join(n_term, "term").withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one")
    gain = F.log(F.col("n_all") * lower_bound(F.col("n_te"), F.col("n_e")) / F.col("n_t"))
    own = F.log(F.col("n_all") / F.col("n_e"))
    return scored.filter((own > 0) & (gain >= share * own)).select("entity", "term")


def private_spans(
    docs: DataFrame, text_col: str = "text", into: str = "spans", share: float = 0.8, keep: list[str] | None = None
) -> DataFrame:
    """Add the spans of every whole text: column ``into`` (replacing one of that name).

    A span has start, rank, end (code points, end exclusive), kind and value; base kinds first,
    ``term`` for what the method adds. An entity of a single text has terms where the corpus is
    large enough to call them rare (some 130 texts at the default ``share``). Terms lie outside base spans. A null text is empty. Copies
    of a text count once in every number; a third of all rows may mention one entity, as counts combine
    before they are shuffled. An empty table gives no rows.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != into]
    # the columns that stay are one struct: no name of a step's column meets theirs
    rows = docs.select(F.struct(*quoted(keep)).alias("_row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_body"))
    rows = rows.withColumn("_base", base_spans("_body"))
    with_some = rows.filter(F.size("_base") > 0)
    found = with_some.select(F.xxhash64("_body").alias("_key"), "_body", "_base")
    evidence_rows = materialize(found.dropDuplicates(["_key"]))
    bodies = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_body")).withColumn("_key", F.xxhash64("_body"))
    terms = materialize(disclosing_terms(evidence_rows, one_of_each(bodies, ["_key"]), share))
    if terms.isEmpty():
        return rows.select("_row.*", F.col("_base").alias(into))
    mentions = evidence_rows.select("_key", F.explode(F.expr("array_distinct(transform(_base, s -> lower(concat(s.kind, ':', s.value))))")).alias("entity"))
    wanted = mentions.join(terms, "entity").select("_key", "term").distinct()
    # words of the texts that mention an entity with terms, each with its place
    places = F.explode(F.expr(located("_body", _literal(r"\p{L}{3,}+"), TERM, len(KINDS)))).alias("place")
    words = evidence_rows.select("_key", places).withColumn("term", F.lower("place.value"))
    told = words.join(wanted, ["_key", "term"]).groupBy("_key").agg(F.collect_list("place").alias("_more"))
    told = materialize(evidence_rows.select("_key", "_base").join(told, "_key").select("_key", F.expr(_outside("_base", "_more")).alias("_more")))
    some = with_some.withColumn("_key", F.xxhash64("_body")).join(told, "_key", "left")
    spans = F.expr("if(_more is null, _base, array_sort(concat(_base, _more)))")
    none = rows.filter(F.size("_base") == 0)
    return some.select("_row.*", spans.alias(into)).union(none.select("_row.*", F.col("_base").alias(into)))


def _outside(base: str, more: str) -> str:
    """SQL for the spans of ``more`` that no span of ``base`` overlaps, by the furthest end before and the next start after."""
    after = running(f"reverse(array_sort(concat({base}, {more})))", f"if(x.rank < {len(KINDS)}, x.start, 2147483647)", "least(a, v)", "2147483647")
    before = running(f"transform(reverse({after}), y -> named_struct('next', y.at, 's', y.x))", f"if(x.s.rank < {len(KINDS)}, x.s.end, 0)", "greatest(a, v)")
    free = f"m -> m.x.s.rank = {len(KINDS)} and m.at <= m.x.s.start and m.x.next >= m.x.s.end"
    return f"transform(filter({before}, {free}), m -> m.x.s)"


def _generalised(text: str, spans: str) -> str:
    """SQL for a text with its spans replaced; overlapping spans are one and its first kind stands for it."""
    pieces = f"""transform(filter({running(spans, 'x.end', 'greatest(a, v)')}, m -> m.x.end > m.at), m -> concat(
        {_piece('m.at', 'm.x.start')}, if(m.x.start < m.at or m.x.kind = '{TERM}', '', concat('[', upper(m.x.kind), ']'))))"""
    last = f"coalesce(array_max(transform({spans}, x -> x.end)), 0)"
    rest = _let("z", last, _let("n", f"length({text})", _piece("z", "n")))
    return _let("c", _chunks(text), f"concat(array_join({pieces}, ''), {rest})")


def sanitised(docs: DataFrame, text_col: str = "text", share: float = 0.8) -> DataFrame:
    """The documents with every span generalised to its kind, such as ``[EMAIL]``; terms are removed.

    What shows only after that, such as a card number that stood next to an IP address, is
    generalised too. Other columns stay; texts without a span, null ones too, stay as they are.
    """
    into, once, rest = (fresh(f"_private_{c}_", docs.columns) for c in ("spans", "once", "rest"))
    found = private_spans(docs, text_col, into, share)
    first = F.when(F.size(into) > 0, F.expr(_generalised(f"`{text_col}`", into)))
    found = found.withColumn(once, first).withColumn(rest, F.when(F.col(once).isNotNull(), base_spans(once)))
    text = F.coalesce(F.when(F.size(rest) > 0, F.expr(_generalised(once, rest))), F.col(once), F.col(f"`{text_col}`")).alias(text_col)
    return found.select(*(text if c == text_col else F.col(f"`{c}`") for c in docs.columns))
