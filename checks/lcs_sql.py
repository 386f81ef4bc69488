"""The longest common subsequence of lists in SQL, bit-parallel over words of 60 bits.

A row of the dynamic program is a list of words; each element of the second list that occurs in the
first turns it into the next one by an addition with carry. Zeros in the last row count the result.
"""

from __future__ import annotations

BITS = 60
FULL = (1 << BITS) - 1

# words of (row, mask) pairs, lowest first; the accumulator is the carry, then the words made so far
_STEP = (
    "list_reduce(list_concat([[0::bigint]], list_transform(list_zip(row, mask), lambda z: [z[1], z[2]])), "
    "lambda made, w: list_concat("
    f"[((w[1] + (w[1] & w[2]) + made[1]) >> {BITS})], made[2:], "
    f"[((w[1] + (w[1] & w[2]) + made[1]) & {FULL}::bigint) | (w[1] - (w[1] & w[2]))]))[2:]"
)


def lcs(pairs: str, ids: list[str], x: str, y: str, name: str = "lcs") -> list[tuple[str, str]]:
    """Tables that end in ``name``: (ids, lcs) for each row of ``pairs``, whose lists x and y are not null."""
    key = ", ".join(ids)
    return [
        (f"{name}_x", f"select {key}, unnest({x}) as e, generate_subscripts({x}, 1) - 1 as i from {pairs}"),
        (f"{name}_bits", f"select {key}, e, i // {BITS} as k, sum(1::bigint << (i % {BITS}))::bigint as bits from {name}_x group by all"),
        (f"{name}_words", f"select {key}, e, map_from_entries(list((k, bits))) as words from {name}_bits group by all"),
        (f"{name}_y", f"select {key}, (len({x}) - 1) // {BITS} as last, unnest({y}) as e, generate_subscripts({y}, 1) as j from {pairs}"),
        (
            f"{name}_masks",
            f"""select {key}, list(list_transform(generate_series(0, last), lambda k: coalesce(words[k], 0::bigint)) order by j) as masks
from {name}_y join {name}_words using ({key}, e) group by all""",
        ),
        (
            f"{name}_rows",
            f"""select {key}, len({x}) as n, list_reduce(
  list_concat([list_transform(generate_series(0, (len({x}) - 1) // {BITS}), lambda k: {FULL}::bigint)], coalesce(masks, [])),
  lambda row, mask: {_STEP}) as words from {pairs} left join {name}_masks using ({key}) where len({x}) > 0""",
        ),
        (
            name,
            f"""select {key}, coalesce(list_sum(list_transform(words, lambda w, k: bit_count(
    xor(w, {FULL}::bigint) & case when k * {BITS} <= n then {FULL}::bigint else (1::bigint << (n % {BITS})) - 1 end))), 0)::bigint as lcs
from {pairs} left join {name}_rows using ({key})""",
        ),
    ]


def characters(text: str) -> str:
    """A text's code points as a list."""
    return f"regexp_extract_all({text}, '(?s).')"
