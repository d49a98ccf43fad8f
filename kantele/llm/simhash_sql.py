"""The SQL of op10_simhash for DuckDB: brute force over all shingles and all pairs of fingerprints.

XXH64 is written out in 128-bit numbers, a step of it a subquery.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

WORD = r"[^\x20\x09-\x0D]"
#: The five primes of XXH64, counted from 1.
PRIMES = (0, 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
#: 2^64; sums and products are taken modulo it.
M = "18446744073709551616::uhugeint"
P = [f"{p}::uhugeint" for p in PRIMES]


def rotated(x: str, by: int) -> str:
    """x turned left within 64 bits."""
    y = f"(({x}) * {1 << by}::uhugeint)"
    return f"({y} % {M} + {y} // {M})"


def little(at: str, size: int) -> str:
    """The little-endian number of ``size`` bytes at a byte offset (from 0) of the hexadecimal text hx."""
    return "('0x' || " + " || ".join(f"substr(hx, 2 * ({at}) + {2 * i + 1}, 2)" for i in reversed(range(size))) + ")::ubigint::uhugeint"


def mixed(x: str, acc: str = "0::uhugeint") -> str:
    """A lane's number after it has read x."""
    return f"({rotated(f'({acc} + ({x}) * {P[2]}) % {M}', 31)} * {P[1]} % {M})"


def simhash_sql(seed: int = 42, budget: int = 3) -> str:
    """Words, shingles, their XXH64, majority bits, links between all fingerprints, and what they reach."""
    steps = []

    def step(name: str, select: str, where: str = "") -> None:
        steps.append(f"{name} as materialized (select {select} from {where or steps[-1].split(' ')[0]})")

    step("d", f"row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{WORD}+') as w", "documents")
    step("s", "r, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] "
         "else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as shingle")
    step("u", "shingle, hex(encode(shingle)) as hx, strlen(shingle) as n, strlen(shingle) // 32 as stripes", "(select distinct shingle from s)")
    starts = [(seed + PRIMES[1] + PRIMES[2]) % (1 << 64), seed + PRIMES[2], seed, (seed - PRIMES[1]) % (1 << 64)]
    lanes = ", ".join(
        f"list_reduce(list_transform(range(stripes), lambda k: {little(f'32 * k + {8 * i}', 8)}), lambda a, x: {mixed('x', 'a')}, {start}::uhugeint) as v{i}" for i, start in enumerate(starts)
    )
    step("l", f"shingle, hx, n, stripes, {lanes}")
    turns = " + ".join(rotated(f"v{i}", by) for i, by in enumerate((1, 7, 12, 18)))
    step("h0", f"*, ({turns}) % {M} as h")
    for i in range(4):
        step(f"h{i + 1}", f"* replace ((xor(h, {mixed(f'v{i}')}) * {P[1]} + {P[4]}) % {M} as h)")
    step("t0", f"shingle, hx, n, 32 * stripes as pos, ((case when stripes > 0 then h else {seed}::uhugeint + {P[5]} end) + n::uhugeint) % {M} as h")
    # What follows the stripes: up to three times eight bytes, four, and up to three single ones.
    for i, (size, prime, by, times, plus) in enumerate([(8, None, 27, 1, 4)] * 3 + [(4, 1, 23, 2, 3)] + [(1, 5, 11, 1, None)] * 3):
        there = f"n - pos >= {size}"
        number = little("pos", size)
        read = mixed(number) if prime is None else f"({number} * {P[prime]} % {M})"
        made = f"({rotated(f'xor(h, {read})', by)} * {P[times]}" + (f" + {P[plus]}" if plus else "") + f") % {M}"
        step(f"t{i + 1}", f"shingle, hx, n, case when {there} then pos + {size} else pos end as pos, case when {there} then {made} else h end as h")
    for i, (by, times) in enumerate([(33, 2), (29, 3), (32, None)]):
        step(f"f{i}", "shingle, xor(h, h // %d::uhugeint)%s as h" % (1 << by, f" * {P[times]} % {M}" if times else ""))
    bits = ", ".join(f"sum((h >> {i}) & 1) as b{i}" for i in range(64))
    step("m", f"r, count(*) as n, {bits}", "(select r, h::ubigint as h from s join f2 using (shingle)) group by r")
    value = " + ".join(f"(case when 2 * b{i} > n then {1 << i}::uhugeint else 0 end)" for i in range(64))
    step("p", f"doc_id, coalesce(({value})::ubigint, 0) as f", "d left join m using (r)")
    step("g", "f, min(doc_id) as least", "p group by f")
    step("e", "a.f as f, b.f as o", f"g a join g b on bit_count(xor(a.f, b.f)) <= {budget}")
    steps.append("reached as (select f, f as o from g union select reached.f, e.o from reached join e on e.f = reached.o)")
    step("c", "reached.f, min(least) as component_id", "reached join g on g.f = reached.o group by reached.f")
    return "with recursive " + ",\n".join(steps) + "\nselect doc_id, format('{:016x}', f) as fingerprint, component_id from p join c using (f)"
