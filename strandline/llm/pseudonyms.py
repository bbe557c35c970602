"""Format-preserving pseudonyms for personal numbers and dates.

A candidate is found by its shape, validated (check digits, number plans,
calendar), and replaced by another valid value of the same format: a Feistel
network keyed by a secret permutes the values of the format among themselves.
Equal values get equal pseudonyms in every document and different values of
one format different ones, so records stay linked; without the key nothing
leads back.

    card       Luhn-valid, 13 to 19 digits: first digit and grouping stay, the
               check digit is computed anew
    iban       mod-97-valid: country and letters stay, check digits anew
    phone      +1 numbers of the North American plan (area and exchange 2-9xx)
               within the plan; other + numbers of 8 to 15 digits, for which
               two leading digits stay
    ssn        area not 000, 666 or 9xx; group and serial not all zero
    ipv4       four octets
    date       Y-M-D, D.M.Y, D/M/Y (M/D/Y where D/M/Y is no date) of 1800 to
               2199: the 400 years of the calendar's cycle, permuted by day
    email      letters and digits of the local part, in base 36; lower case
    hex        standalone runs of 32 to 128 hex digits (keys, tokens)

Everything is Catalyst expressions on one row: no shuffle, no Python.
Half-rounds alternate l += F(r), r += F(l) modulo the sizes of the halves,
which is a bijection for any two sizes; the day cycle has 189 x 773 days.
F is SHA-256 of key, format, round and the other half.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Alternatives in order; all are tried at each place of the text.
SHAPES = {
    "email": r"[\p{L}\p{N}](?:[\p{L}\p{N}._%+-]{0,63})@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.){1,8}[A-Za-z]{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
    "ipv4": r"(?<!\w)(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    "date": r"(?<![\w./-])(?:(?:18|19|20|21)\d\d([-/])\d\d\1\d\d|\d\d([./])\d\d\2(?:18|19|20|21)\d\d)(?![\w/-]|\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]|\.\d)",
    "card": r"(?<![\w.])(?:\d{13,19}|\d{4}([ -])\d{4}\3\d{4}\3\d{1,7}|\d{4}([ -])\d{6}\4\d{5})(?![\w])",
}
KINDS = tuple(SHAPES)
PATTERN = "|".join(SHAPES.values())


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def _feistel(kind: str, left: str, right: str, size_l: str, size_r: str, key: str) -> str:
    """SQL of the struct (l, r) after all half-rounds."""
    hashed = f"cast(conv(substr(sha2(concat_ws('|', {_quote(key)}, '{kind}', {size_l}, {size_r}, i, s.r), 256), 1, 15), 16, 10) as bigint)"
    step = f"named_struct('l', s.r, 'r', (s.l + {hashed}) % if(i % 2 = 1, {size_l}, {size_r}))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> {step})"


def _number(s: str, radix: int) -> str:
    return f"coalesce(cast(conv({s}, {radix}, 10) as bigint), 0L)"


def _string(v: str, radix: int, n: str) -> str:
    return f"if({n} = 0, '', lpad(lower(conv(cast({v} as string), 10, {radix})), {n}, '0'))"


def _permuted(kind: str, s: str, radix: int, block: int, key: str) -> str:
    """SQL: a string over the first ``radix`` digits and letters, permuted.

    Blocks of at most ``block`` characters keep both halves in 62 bits.
    """
    part = f"substr(w, 1 + {block} * b, {block})"
    half = f"(length({part}) div 2)"
    sizes = [f"cast(pow({radix}D, {n}) as bigint)" for n in (half, f"length({part}) - {half}")]
    net = _feistel(kind, _number(f"substr({part}, 1, {half})", radix), _number(f"substr({part}, 1 + {half})", radix), *sizes, key)
    back = f"concat({_string('o.l', radix, half)}, {_string('o.r', radix, f'length({part}) - {half}')})"
    one = f"element_at(transform(array({net}), o -> {back}), 1)"
    return f"element_at(transform(array({s}), w -> if(w = '', w, array_join(transform(sequence(0, (length(w) - 1) div {block}), b -> {one}), ''))), 1)"


def _placed(m: str, new: str, keep: str) -> str:
    """SQL: the characters of ``new`` in the places of ``m`` that match ``keep``."""
    count = f"length(regexp_replace(substr({m}, 1, p), '[^{keep}]', ''))"
    return f"element_at(transform(array({new}), n -> array_join(transform(sequence(1, length({m})), p -> if(substr({m}, p, 1) rlike '[{keep}]', substr(n, {count}, 1), substr({m}, p, 1))), '')), 1)"


def _luhn_digit(s: str) -> str:
    """SQL: the check digit to follow the digits ``s``."""
    total = f"aggregate(sequence(1, length({s})), 0L, (t, p) -> t + if((length({s}) - p) % 2 = 0, (2 * int(substr({s}, p, 1))) div 10 + (2 * int(substr({s}, p, 1))) % 10, int(substr({s}, p, 1))))"
    return f"cast((10 - {total} % 10) % 10 as string)"


def _mod97(s: str) -> str:
    value = "(ascii(c) - if(c rlike '[0-9]', 48, 55))"
    return f"aggregate(filter(split({s}, ''), c -> c != ''), 0, (t, c) -> (t * if(c rlike '[0-9]', 10, 100) + {value}) % 97)"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _card(key: str) -> str:
    payload = f"concat(substr(d, 1, 1), {_permuted('card', 'substr(d, 2, length(d) - 2)', 10, 36, key)})"
    new = _let(payload, "q", f"concat(q, {_luhn_digit('q')})")
    return _let(_digits("m"), "d", f"if(luhn_check(d), {_placed('m', new, '0-9')}, null)")


def _iban(key: str) -> str:
    compact = "replace(m, ' ', '')"
    valid = f"{_mod97('concat(substr(c0, 5), substr(c0, 1, 4))')} = 1"
    body = _let(_permuted("iban", _digits("substr(c0, 5)"), 10, 36, key), "y", _placed("substr(c0, 5)", "y", "0-9"))
    check = "lpad(cast(98 - " + _mod97("concat(z, substr(c0, 1, 2), '00')") + " as string), 2, '0')"
    new = _let(body, "z", f"concat(substr(c0, 1, 2), {check}, z)")
    return _let(compact, "c0", f"if({valid}, {_placed('m', new, 'A-Z0-9')}, null)")


def _phone(key: str) -> str:
    own = _feistel("nanp", "int(substr(d, 2, 3)) - 200", "(int(substr(d, 5, 3)) - 200) * 10000L + int(substr(d, 8, 4))", "800", "8000000", key)
    nanp = _let(own, "o", "concat('1', cast(o.l + 200 as string), cast(o.r div 10000 + 200 as string), lpad(cast(o.r % 10000 as string), 4, '0'))")
    other = f"concat(substr(d, 1, 2), {_permuted('phone', 'substr(d, 3)', 10, 36, key)})"
    plan = "length(d) = 11 and d rlike '^1[2-9][0-9]{2}[2-9]'"
    new = f"if({plan}, {nanp}, {other})"
    return _let(_digits("m"), "d", f"if(({plan}) or length(d) between 8 and 15, {_placed('m', new, '0-9')}, null)")


def _ssn(key: str) -> str:
    area = "int(substr(d, 1, 3))"
    net = _feistel("ssn", f"{area} - if({area} > 666, 2, 1)", "(int(substr(d, 4, 2)) - 1) * 9999L + int(substr(d, 6, 4)) - 1", "898", "989901", key)
    new = _let(net, "o", "concat(lpad(cast(o.l + if(o.l >= 665, 2, 1) as string), 3, '0'), lpad(cast(o.r div 9999 + 1 as string), 2, '0'), lpad(cast(o.r % 9999 + 1 as string), 4, '0'))")
    return _let(_digits("m"), "d", f"if({area} between 1 and 899 and {area} != 666 and substr(d, 4, 2) != '00' and substr(d, 6, 4) != '0000', {_placed('m', new, '0-9')}, null)")


def _ipv4(key: str) -> str:
    net = _feistel("ipv4", "int(q[0]) * 256 + int(q[1])", "int(q[2]) * 256 + int(q[3])", "65536", "65536", key)
    return _let("split(m, '[.]')", "q", _let(net, "o", "concat_ws('.', o.l div 256, o.l % 256, o.r div 256, o.r % 256)"))


def _date(key: str) -> str:
    """Tried as Y-M-D, D-M-Y, M-D-Y; the one that is a date is permuted."""
    first, second, last = "regexp_extract(m, '^([0-9]+)', 1)", "regexp_extract(m, '^[0-9]+.([0-9]+)', 1)", "regexp_extract(m, '([0-9]+)$', 1)"
    dated = lambda y, mo, d: f"try_to_date(concat_ws('-', {y}, {mo}, {d}), 'yyyy-MM-dd')"
    days = "datediff(t, date'1800-01-01')"
    net = _feistel("date", f"{days} div 773", f"{days} % 773", "189", "773", key)
    moved = lambda shape: _let(net, "o", f"date_format(date_add(date'1800-01-01', cast(o.l * 773 + o.r as int)), {shape})")
    mark = "regexp_extract(m, '[^0-9]', 0)"
    tried = lambda value, shape, other: f"if({value} is null, {other}, {_let(value, 't', moved(shape))})"
    ymd = tried(dated(first, second, last), f"concat('yyyy', {mark}, 'MM', {mark}, 'dd')", "null")
    dmy = tried(dated(last, second, first), f"concat('dd', {mark}, 'MM', {mark}, 'yyyy')", f"if({mark} = '/', {tried(dated(last, first, second), "'MM/dd/yyyy'", 'null')}, null)")
    return f"if(length({first}) = 4, {ymd}, {dmy})"


def _email(key: str) -> str:
    local = "lower(substring_index(m, '@', 1))"
    new = _permuted("email", "regexp_replace(a, '[^0-9a-z]', '')", 36, 22, key)
    return _let(local, "a", f"concat({_placed('a', new, '0-9a-z')}, '@', substring_index(m, '@', -1))")


def _hex(key: str) -> str:
    new = _permuted("hex", "lower(m)", 16, 28, key)
    return f"if(m rlike '[0-9]' and m rlike '[A-Fa-f]', if(m rlike '[A-F]', upper({new}), {new}), null)"


_MAKERS = {"email": _email, "iban": _iban, "hex": _hex, "ipv4": _ipv4, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}


def _own(kind: str) -> str:
    """The shape alone: without what must not stand around it, groups from 1."""
    shape = SHAPES[kind]
    shape = re.sub(r"\(\?<!(?:\[[^\]]*\]|[^()])*\)", "", shape)
    shape = re.sub(r"\(\?!(?:\[[^\]]*\]|[^()])*\)$", "", shape)
    return {"card": shape.replace(r"\3", r"\1").replace(r"\4", r"\2")}.get(kind, shape)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with personal values in ``text`` replaced; other columns stay,
    whatever their names.

    Null texts stay null, empty ones empty, and texts may be of any length.
    Candidates that do not validate stay as they are. Equal rows stay equal,
    and an empty table stays empty.
    """
    return _replaced(docs, key, text, {})


def pseudonymise_counted(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """As ``pseudonymise``, with ``n_values`` and ``n_<kind>`` (clashing names
    of ``docs`` are replaced)."""
    counts = {"n_values": "cast(size({0}) as bigint)"} | {f"n_{k}": f"cast(size(filter({{0}}, x -> x = '{k}')) as bigint)" for k in KINDS}
    return _replaced(docs, key, text, counts)


def _free(docs: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``docs`` has it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _replaced(docs: DataFrame, key: str, text: str, counts: dict[str, str]) -> DataFrame:
    found, new, kinds = (_free(docs, n) for n in ("found", "new", "kinds"))
    fits = lambda k: f"m rlike {_quote('^(?:' + _own(k) + ')$')}"
    cases = " ".join(f"when {fits(k)} then named_struct('k', '{k}', 'v', {_MAKERS[k](key)})" for k in KINDS)
    out = docs.withColumn(found, F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)))
    out = out.withColumn(new, F.expr(f"transform(`{found}`, m -> case {cases} end)"))
    pieces = F.split(F.col(text), PATTERN, -1)
    texts = F.transform(F.arrays_zip(F.col(found).alias("found"), F.col(new).alias("new")), lambda x: F.coalesce(x["new"]["v"], x["found"]))
    woven = F.array_join(F.zip_with(pieces, texts, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
    out = out.withColumn(text, F.when(F.size(found) > 0, woven).otherwise(F.col(text)))
    valid = F.transform(F.filter(F.col(new), lambda x: x["v"].isNotNull()), lambda x: x["k"])
    out = out.withColumn(kinds, F.coalesce(valid, F.array().cast("array<string>"))).drop(found, new)
    for name, value in counts.items():
        out = out.withColumn(name, F.expr(value.format(f"`{kinds}`")))
    return out.drop(kinds)
