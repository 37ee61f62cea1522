"""Format-preserving pseudonyms for personal numbers and dates, by a keyed Feistel network.

Found and validated: payment cards (13 to 19 digits, or four groups of four, with a right check
digit), telephone numbers (North American ones by area and exchange), US social security numbers (no impossible area, group or serial),
IPv4 addresses (octets up to 255, without leading zeros), calendar dates of 1800 to 2199 (ISO, or day/month/year with
slashes or points) and the local part of e-mail addresses.  What fails validation is left alone.

Each value is split into a pair of numbers (l, r) below (A, B), and alternate rounds add a keyed
hash of one to the other: a permutation of all A x B values, so different values stay different
and equal values get equal pseudonyms in all documents.  The pair covers exactly the valid
values of the kind: a card's check digit is computed anew, a date stays a date, an SSN stays
possible; punctuation, a card's or telephone's grouping and an address's domain stay.  Letters and digits of
an e-mail's local part are permuted as one alphabet of 36, in their places.

Everything is SQL expressions over one row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm import textkit as tk

ROUNDS = 8
KINDS = ("card", "phone", "ssn", "ip", "date", "email")

_BEFORE, _AFTER = r"(?<![0-9A-Za-z_.+-])", r"(?![0-9A-Za-z_])"
_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)++",
    "date": _BEFORE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})" + _AFTER,
    "ip": _BEFORE + r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z_]|\.[0-9])",
    "ssn": _BEFORE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _AFTER,
    "phone": r"(?<![0-9A-Za-z_.+(-])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}" + _AFTER,
    "card": _BEFORE + r"(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3})" + _AFTER,
}
ANY = "|".join(f"(?:{p})" for p in _PATTERNS.values())


def _sql(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def feistel(l: str, r: str, a: str, b: str, key: str, tweak: str) -> str:
    """SQL of a struct (l, r): ``l`` below ``a`` and ``r`` below ``b`` after the rounds."""

    def prf(i: str, v: str, n: str) -> str:
        # 60 bits of a keyed SHA-256, reduced to the range
        return f"pmod(cast(conv(substr(sha2(concat_ws('|', '{_sql(key)}', {tweak}, {i}, {v}, {n}), 256), 1, 15), 16, 10) as bigint), {n})"

    step = f"named_struct('l', pmod(s.l + {prf('2 * i', 's.r', a)}, {a}), 'r', s.r)"
    then = f"transform(array({step}), s -> named_struct('l', s.l, 'r', pmod(s.r + {prf('2 * i + 1', 's.l', b)}, {b})))[0]"
    return f"aggregate(sequence(1, {ROUNDS // 2}), named_struct('l', cast({l} as bigint), 'r', cast({r} as bigint)), (s, i) -> {then})"


def _with(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once for ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def luhn_sum(digits: str) -> str:
    """SQL of the weighted digit sum of a payload to which a check digit will be appended."""
    folded = "element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(c as int) + 1)"
    return f"aggregate(transform(regexp_extract_all(reverse({digits}), '.', 0), (c, k) -> if(k % 2 = 0, {folded}, cast(c as int))), 0, (t, c) -> t + c)"


def _digits(n: int | str, value: str) -> str:
    return f"lpad(cast({value} as string), cast({n} as int), '0')"


def _refill(shape: str, digits: str) -> str:
    """SQL that puts ``digits`` in the places of the digits of ``shape``, keeping all else."""
    return f"aggregate(regexp_extract_all({shape}, '.', 0), named_struct('k', 1, 'o', ''), (q, c) -> if(c rlike '[0-9]', named_struct('k', q.k + 1, 'o', concat(q.o, substr({digits}, q.k, 1))), named_struct('k', q.k, 'o', concat(q.o, c))), q -> q.o)"


def _permuted_digits(d: str, key: str, kind: str) -> str:
    """SQL: the digit string ``d`` (2 to 20 digits) permuted among those of its length."""
    half = f"length({d}) div 2"
    a, b = f"cast(rpad('1', {half} + 1, '0') as bigint)", f"cast(rpad('1', length({d}) - {half} + 1, '0') as bigint)"
    pair = feistel(f"substr({d}, 1, {half})", f"substr({d}, {half} + 1)", a, b, key, f"'{kind}', length({d})")
    return _with("f", pair, f"concat({_digits(half, 'f.l')}, {_digits(f'length({d}) - {half}', 'f.r')})")


def _card(m: str, key: str) -> str:
    d = f"regexp_replace({m}, '[^0-9]', '')"
    payload = "substr(d, 1, length(d) - 1)"
    valid = f"{luhn_sum(payload)} % 10 = (10 - cast(right(d, 1) as int)) % 10 and d rlike '[1-9]'"
    new = _with("p", _with("y", payload, _permuted_digits("y", key, "card")), f"concat(p, cast((10 - {luhn_sum('p')} % 10) % 10 as string))")
    return _with("d", d, f"if({valid}, {_with('w', new, _refill(m, 'w'))}, cast(null as string))")


def _phone(m: str, key: str) -> str:
    """North American numbers (no country code, or 1) stay possible: area and exchange begin with 2 to 9.
    Ten digits after another country code are permuted among all."""
    d = f"regexp_replace({m}, '[^0-9]', '')"
    area, office, line = (f"cast(substr(y, {i}, {n}) as bigint)" for i, n in ((1, 3), (4, 3), (7, 4)))
    pair = feistel(f"{area} - 200", f"({office} - 200) * 10000 + {line}", "800L", "8000000L", key, "'phone'")
    american = f"if(y rlike '^[2-9]..[2-9]', {_with('f', pair, f'concat({_digits(3, 'f.l + 200')}, {_digits(7, 'f.r + 2000000')})')}, cast(null as string))"
    other = _with("z", "y", _permuted_digits("z", key, "phone"))
    ten = _with("y", "right(d, 10)", f"if(length(d) = 10 or length(d) = 11 and d like '1%', {american}, {other})")
    return _with("d", d, _with("w", f"concat(substr(d, 1, length(d) - 10), {ten})", f"if(w is null, cast(null as string), {_refill(m, 'w')})"))


def _ssn(m: str, key: str) -> str:
    area, group, serial = (f"cast(substr({m}, {i}, {n}) as int)" for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = f"{area} between 1 and 899 and {area} != 666 and {group} > 0 and {serial} > 0"
    pair = feistel(f"{area} - if({area} > 666, 2, 1)", f"({group} - 1) * 9999 + {serial} - 1", "898L", "989901L", key, "'ssn'")
    new = _with("f", pair, f"concat({_digits(3, 'f.l + if(f.l >= 665, 2, 1)')}, '-', {_digits(2, 'f.r div 9999 + 1')}, '-', {_digits(4, 'f.r % 9999 + 1')})")
    return f"if({valid}, {new}, cast(null as string))"


def _ip(m: str, key: str) -> str:
    o = [f"cast(split_part({m}, '.', {k}) as bigint)" for k in (1, 2, 3, 4)]
    valid = " and ".join(f"{x} <= 255" for x in o) + f" and not {m} rlike '(^|[.])0[0-9]'"
    pair = feistel(f"{o[0]} * 256 + {o[1]}", f"{o[2]} * 256 + {o[3]}", "65536L", "65536L", key, "'ip'")
    new = _with("f", pair, "concat_ws('.', f.l div 256, f.l % 256, f.r div 256, f.r % 256)")
    return f"if({valid}, {new}, cast(null as string))"


def _date(m: str, key: str) -> str:
    """400 years have 146,097 = 189 x 773 days, so the pair covers the range exactly."""
    kinds = {r"^....-": "yyyy-MM-dd", "/": "dd/MM/yyyy", r"\\.": "dd.MM.yyyy"}
    out = "cast(null as string)"
    for mark, fmt in kinds.items():
        day = f"datediff(cast(try_to_timestamp({m}, '{fmt}') as date), date'1800-01-01')"
        pair = feistel("n div 773", "n % 773", "189L", "773L", key, "'date'")
        new = _with("f", pair, f"date_format(date_add(date'1800-01-01', cast(f.l * 773 + f.r as int)), '{fmt}')")
        out = f"if({m} rlike '{mark}', {_with('n', day, f'if(n between 0 and 146096, {new}, cast(null as string))')}, {out})"
    return out


def _email(m: str, key: str) -> str:
    """Runs of letters and digits of the local part, up to ten characters at a time, in base 36."""
    run = "lower(x)"
    half = "length(x) div 2"
    power = lambda n: f"cast(pow(36, {n}) as bigint)"
    number = lambda t: f"coalesce(cast(conv({t}, 36, 10) as bigint), 0L)"
    pair = feistel(number(f"substr({run}, 1, {half})"), number(f"substr({run}, {half} + 1)"), power(half), power(f"length(x) - {half}"), key, "'email', length(x)")
    word = lambda v, n: f"right(concat('0000000000', lower(conv(cast({v} as string), 10, 36))), cast({n} as int))"
    new = _with("f", pair, f"concat({word('f.l', half)}, {word('f.r', f'length(x) - {half}')})")
    parts = f"regexp_extract_all(split_part({m}, '@', 1), '([A-Za-z0-9]{{1,10}}|[^A-Za-z0-9]+)', 1)"
    return f"concat(array_join(transform({parts}, x -> if(x rlike '[A-Za-z0-9]', {new}, x)), ''), substr({m}, instr({m}, '@')))"


def _replacement(m: str, key: str) -> str:
    """SQL of (kind, new text) of one match; the kind is null where validation fails."""
    q = {k: "'" + _sql("^" + p.replace(_BEFORE, "").replace(_AFTER, "") + "$") + "'" for k, p in _PATTERNS.items()}
    cases = ((f"contains({m}, '@')", "email", _email), (f"{m} rlike {q['date']}", "date", _date), (f"{m} rlike {q['ip']}", "ip", _ip), (f"{m} rlike {q['ssn']}", "ssn", _ssn), (f"{m} rlike '[().-]' and {m} rlike {q['phone']}", "phone", _phone), ("true", "card", _card))
    body = " ".join(f"when {test} then named_struct('kind', '{kind}', 'to', {make(m, key)})" for test, kind, make in cases)
    return f"case {body} end"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in its texts and a column n_<kind> per kind of value replaced.

    Null texts stay null and empty ones empty, with counts of 0.
    """
    text, p = f"`{text_col}`", tk.fresh(docs)
    m, to, gap = f"{p}m", f"{p}to", f"{p}g"
    found = F.expr(f"case when {text} rlike '[0-9@]' then regexp_extract_all({text}, '{_sql(ANY)}', 0) else cast(array() as array<string>) end")
    out = docs.withColumn(m, F.coalesce(found, F.array().cast("array<string>")))
    out = out.withColumn(to, F.expr(f"transform({m}, m -> {_replacement('m', key)})"))
    gaps = F.expr(f"split({text}, '{_sql(ANY)}', -1)")
    joined = F.expr(f"array_join(flatten(zip_with({gap}, transform({to}, (x, i) -> coalesce(x.to, element_at({m}, i + 1))), (g, v) -> array(g, coalesce(v, '')))), '')")
    out = out.withColumn(gap, F.when(F.size(m) > 0, gaps))
    counts = {f"n_{k}": F.expr(f"cast(size(filter({to}, x -> x.kind = '{k}' and x.to is not null)) as bigint)") for k in KINDS}
    out = tk.with_outputs(out, **{text_col: F.when(F.size(m) > 0, joined).otherwise(F.col(text)), **counts})
    return out.drop(m, to, gap)
