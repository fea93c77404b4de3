"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Values are found by pattern, validated (check digits, octet and calendar ranges, number ranges),
brought to one spelling (national digits, lower case) and sent through a keyed Feistel network over
that spelling; the result fills the format that was found. So a value has the same pseudonym in
every document and spelling, and different values of a format keep different ones.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fresh

ROUNDS = 8

#: Whole-value patterns by kind, in order of preference where two match at the same place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "hex": r"(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9_-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9])\+[1-9][0-9]{7,14}(?![0-9])|(?<![0-9])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?[ .-][0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])|(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ip6": r"(?<![A-Za-z0-9:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})(?![A-Za-z0-9:])",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: What every pattern needs one of.
SOME = "[0-9@]|[a-f]{32}|AKIA|ASIA|gh[pousr]_|sk-"

#: Country codes of the public numbering plan: two with one digit, these with two, all others with three.
COUNTRY = "^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

#: Days of 1900-03-01 to 2100-02-28, as a product of two factors.
DAYS = (17, 4297)


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number_feistel(left: str, right: str, mods: tuple[int, int], tweak: str) -> str:
    """SQL for ``struct(a, b)``: (left, right) permuted in Z_mods[0] x Z_mods[1]."""
    a, b = mods
    draw = lambda v, m: f"(cast(conv(substr(sha2(concat({tweak}, ':', r, ':', {v}), 256), 1, 15), 16, 10) as bigint) % {m}L)"
    even = f"named_struct('a', (s.a + {draw('s.b', a)}) % {a}L, 'b', s.b)"
    odd = f"named_struct('a', s.a, 'b', (s.b + {draw('s.a', b)}) % {b}L)"
    start = f"named_struct('a', cast({left} as bigint), 'b', cast({right} as bigint))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, r) -> if(r % 2 = 0, {even}, {odd}))"


def _shifted(text: str, stream: str, hexadecimal: bool) -> str:
    """SQL: each letter or digit of ``text`` moved within its class by a byte of ``stream``."""
    by = f"cast(conv(substr({stream}, 2 * (i % 64) + 1, 2), 16, 10) as int)"
    c = f"substr({text}, i + 1, 1)"
    move = lambda base, n: f"chr({base} + pmod({by} + ascii({c}) - {base}, {n}))"
    if hexadecimal:
        one = f"substr('0123456789abcdef', pmod(instr('0123456789abcdef', {c}) - 1 + {by}, 16) + 1, 1)"
    else:
        one = f"case when {c} between '0' and '9' then {move(48, 10)} when {c} between 'a' and 'z' then {move(97, 26)} when {c} between 'A' and 'Z' then {move(65, 26)} else {c} end"
    return f"array_join(transform(sequence(0, length({text}) - 1), i -> {one}), '')"


def text_feistel(text: str, tweak: str, hexadecimal: bool = False) -> str:
    """SQL: ``text`` (two characters or more) permuted letter by letter within each class."""
    stream = lambda v: f"sha2(concat({tweak}, ':', r, ':', {v}), 512)"
    even = f"named_struct('a', {_shifted('s.a', stream('s.b'), hexadecimal)}, 'b', s.b)"
    odd = f"named_struct('a', s.a, 'b', {_shifted('s.b', stream('s.a'), hexadecimal)})"
    half = f"cast(length({text}) div 2 as int)"
    start = f"named_struct('a', substr({text}, 1, {half}), 'b', substr({text}, {half} + 1))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, r) -> if(r % 2 = 0, {even}, {odd}), s -> concat(s.a, s.b))"


def _luhn_sum(digits: str, odd: int) -> str:
    """SQL: the Luhn sum of ``digits``; every second digit is doubled, from the right, starting at place ``odd``."""
    d = f"cast(substr({digits}, length({digits}) - i, 1) as int)"
    twice = f"if({d} > 4, 2 * {d} - 9, 2 * {d})"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (t, i) -> t + if(i % 2 = {odd}, {twice}, {d}))"


def _filled(template: str, digits: str, of: str = "[0-9]") -> str:
    """SQL: ``template`` with its digits (or other characters ``of``) replaced by ``digits`` in turn."""
    step = f"if(c rlike '{of}', named_struct('t', concat(s.t, substr({digits}, s.k + 1, 1)), 'k', s.k + 1), named_struct('t', concat(s.t, c), 'k', s.k))"
    return f"aggregate(split({template}, ''), named_struct('t', '', 'k', 0), (s, c) -> {step}, s -> s.t)"


def _cased(template: str, text: str) -> str:
    """SQL: ``text`` with capitals where ``template`` (of the same length) has them."""
    one = f"if(substr({template}, i + 1, 1) between 'A' and 'Z', upper(substr({text}, i + 1, 1)), substr({text}, i + 1, 1))"
    return f"array_join(transform(sequence(0, length({template}) - 1), i -> {one}), '')"


def _mod97(text: str) -> str:
    """SQL: the remainder by 97 of ``text`` read as a number, letters standing for 10 to 35."""
    step = "if(c between '0' and '9', (t * 10 + cast(c as int)) % 97, (t * 100 + ascii(c) - 55) % 97)"
    return f"aggregate(split({text}, ''), 0, (t, c) -> {step})"


def _card(m: str) -> str:
    """SQL: the longest run of whole digit groups of ``m`` with 13 to 19 digits and a right check digit, or null."""
    groups = f"regexp_extract_all({m}, '[0-9]+[ -]?', 0)"
    runs = f"flatten(transform(sequence(1, size({groups})), a -> transform(sequence(a, size({groups})), b -> regexp_replace(array_join(slice({groups}, a, b - a + 1), ''), '[ -]$', ''))))"
    digits = "regexp_replace(w, '[^0-9]', '')"
    good = f"filter({runs}, w -> length({digits}) between 13 and 19 and {_luhn_sum(digits, 1)} % 10 = 0)"
    return f"try_element_at(array_sort({good}, (v, w) -> length(w) - length(v)), 1)"


def _day(m: str) -> str:
    """SQL: the date that ``m`` writes (year first, else day first, else month first), or null."""
    part = lambda k: f"split({m}, '[-/.]')[{k}]"
    date = lambda y, mo, d: f"try_to_date(concat({part(y)}, '-', lpad({part(mo)}, 2, '0'), '-', lpad({part(d)}, 2, '0')), 'yyyy-MM-dd')"
    return f"if({m} like '____-%', {date(0, 1, 2)}, coalesce({date(2, 1, 0)}, {date(2, 0, 1)}))"


def _kind(m: str) -> str:
    """SQL: the kind of a match, null if it is not valid."""
    whole = {k: quoted(f"^(?:{p})$") for k, p in PATTERNS.items()}
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    octets = f"forall(split({m}, '[.]'), o -> cast(o as int) <= 255)"
    ssn = f"substr({m}, 1, 3) not in ('000', '666') and substr({m}, 1, 1) <> '9' and substr({m}, 5, 2) <> '00' and substr({m}, 8) <> '0000'"
    days = f"datediff({_day(m)}, date'1900-03-01')"
    plain = f"replace({m}, ' ', '')"
    return f"""case
      when {m} rlike {whole["email"]} then 'email'
      when {m} rlike {whole["hex"]} then 'hex'
      when {m} rlike {whole["key"]} then 'key'
      when {m} rlike {whole["iban"]} then if({_mod97(f"concat(substr({plain}, 5), substr({plain}, 1, 4))")} = 1, 'iban', null)
      when {m} rlike {whole["phone"]} then 'phone'
      when {m} rlike {whole["ip6"]} then 'ip6'
      when {m} rlike {whole["ip"]} then if({octets}, 'ip', null)
      when {m} rlike {whole["ssn"]} then if({ssn}, 'ssn', null)
      when {m} rlike {whole["date"]} then if({days} between 0 and {DAYS[0] * DAYS[1] - 1}, 'date', null)
      when {m} rlike {whole["card"]} then if({_luhn_sum(digits, 1)} % 10 = 0 or {_card(m)} is not null, 'card', null)
    end"""


def _pseudonym(m: str, kind: str, key: str) -> str:
    """SQL: the pseudonym of value ``m`` of ``kind`` under ``key``; the plan holds keys derived from it alone."""
    tweak = lambda name: quoted(hmac.new(key.encode(), name.encode(), hashlib.sha256).hexdigest())
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    stem = f"substring_index({m}, '.', size(split({m}, '[.]')) - 1)"
    bound = lambda value, body: f"element_at(transform(array({value}), x -> {body}), 1)"
    email = f"concat({_cased(stem, text_feistel(f'lower({stem})', tweak('email')))}, substr({m}, length({stem}) + 1))"
    country = f"if({m} like '+%', regexp_extract({digits}, {quoted(COUNTRY)}, 0), '1')"
    known = f"named_struct('c', {country}, 'd', if({m} like '+%', {digits}, concat('1', {digits})))"
    moved = text_feistel("substr(x.d, length(x.c) + 1)", f"concat({tweak('phone')}, ':', x.c)")
    phone = bound(known, _filled(m, f"if({m} like '+%', concat(x.c, {moved}), {moved})"))
    key_start = f"regexp_extract({m}, '^(?:AKIA|ASIA|gh[a-z]_|sk-)', 0)"
    api = f"concat({key_start}, {text_feistel(f'substr({m}, length({key_start}) + 1)', tweak('key'))})"
    ip6 = _cased(m, _filled(m, text_feistel(f"lower(replace({m}, ':', ''))", tweak("ip6"), True), "[0-9A-Fa-f]"))
    bank = text_feistel(f"substr(replace({m}, ' ', ''), 5)", f"concat({tweak('iban')}, ':', substr({m}, 1, 2))")
    check97 = _mod97(f"concat(x, substr({m}, 1, 2), '00')")
    iban = bound(bank, _filled(m, f"concat(substr({m}, 1, 2), lpad(cast(98 - {check97} as string), 2, '0'), x)", "[0-9A-Z]"))
    octet = lambda k: f"cast(split({m}, '[.]')[{k}] as bigint)"
    ip = number_feistel(f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", (65536, 65536), tweak("ip"))
    ip = f"transform(array({ip}), v -> concat_ws('.', v.a div 256, v.a % 256, v.b div 256, v.b % 256))[0]"
    area = f"(cast(substr({m}, 1, 3) as int) - if(substr({m}, 1, 3) > '666', 2, 1))"
    ssn = number_feistel(area, f"(cast(substr({m}, 5, 2) as int) - 1) * 9999 + cast(substr({m}, 8) as int) - 1", (898, 99 * 9999), tweak("ssn"))
    ssn = f"transform(array({ssn}), v -> concat_ws('-', lpad(v.a + if(v.a >= 665, 2, 1), 3, '0'), lpad(v.b div 9999 + 1, 2, '0'), lpad(v.b % 9999 + 1, 4, '0')))[0]"
    days = f"datediff({_day(m)}, date'1900-03-01')"
    date = number_feistel(f"{days} div {DAYS[1]}", f"{days} % {DAYS[1]}", DAYS, tweak("date"))
    date = f"date_add(date'1900-03-01', cast(element_at(transform(array({date}), v -> v.a * {DAYS[1]} + v.b), 1) as int))"
    sep = f"if({m} like '%/%', '/', '.')"
    day_first = f"try_to_date(concat_ws('-', split({m}, '[/.]')[2], lpad(split({m}, '[/.]')[1], 2, '0'), lpad(split({m}, '[/.]')[0], 2, '0')), 'yyyy-MM-dd') is not null"
    wide = lambda f: f"if(length({m}) = 10, lpad({f}, 2, '0'), cast({f} as string))"
    date = f"""transform(array({date}), v -> case when {m} like '____-%' then cast(v as string)
      when {day_first} then concat_ws({sep}, {wide("day(v)")}, {wide("month(v)")}, year(v))
      else concat_ws({sep}, {wide("month(v)")}, {wide("day(v)")}, year(v)) end)[0]"""
    value = f"named_struct('w', if({_luhn_sum(digits, 1)} % 10 = 0, {m}, {_card(m)}))"
    own = "regexp_replace(x.w, '[^0-9]', '')"
    inner = f"concat(substr({own}, 1, 1), {text_feistel(f'substr({own}, 2, length({own}) - 2)', tweak('card'))})"
    check = f"cast(pmod(-({_luhn_sum('p', 0)}), 10) as string)"
    whole = _filled("x.w", f"concat(p, {check})")
    card = bound(value, f"replace({m}, x.w, element_at(transform(array({inner}), p -> {whole}), 1))")
    return f"""case {kind} when 'email' then {email} when 'hex' then {text_feistel(m, tweak("hex"), True)}
      when 'key' then {api} when 'iban' then {iban} when 'ip6' then {ip6} when 'phone' then {phone} when 'ip' then {ip} when 'ssn' then {ssn} when 'date' then {date} when 'card' then {card} else {m} end"""


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", kinds_col: str | None = None) -> DataFrame:
    """``docs`` with every valid value in ``text_col`` replaced by its pseudonym under ``key``.

    E-mail addresses keep their shape, capitals and top-level domain, phone numbers their country
    code and separators, card numbers their first digit, separators and a right check digit, bank
    accounts (IBAN) their country and right check digits, API keys their prefix; dates stay
    dates, addresses stay addresses, hexadecimal secrets stay hexadecimal. Phone numbers link by
    their digits (a number of the form 743-555-3824 counts as one of country 1), e-mail addresses
    whatever their capitals. A run of digit groups that is no card number as a whole is searched
    for the longest run of groups that is. Values that do not validate (a wrong check digit, an
    octet over 255, no such day) are left alone.

    ``kinds_col`` names a new array column of the kinds found, in order. Null texts stay null
    (no kinds), empty ones empty; texts of any length are read whole; repeated rows have equal
    results; every row and all other columns stay as they are. A date that can only be read
    month first shares its pseudonyms with the day-first ones; a date without leading zeros may
    change its width. Spellings of one IPv6 address with and without ``::`` are not linked.
    The query plan holds keys derived from ``key``, not the key.
    """
    if kinds_col is not None and kinds_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"{kinds_col} is a column already")
    found, gaps, marked = fresh(docs, "pii_found", "pii_gaps", "pii_marked")
    text = column(docs, text_col)
    some = text.rlike(SOME)
    step = docs.withColumn(found, F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    step = step.withColumn(gaps, F.when(F.size(found) > 0, F.split(text, ANY, -1)))
    kinds = f"transform(`{found}`, m -> named_struct('m', m, 'kind', {_kind('m')}))"
    step = step.withColumn(marked, F.when(F.size(found) > 0, F.expr(kinds)))
    value = _pseudonym("hit.m", "hit.kind", key)
    fresh_values = F.expr(f"transform(`{marked}`, hit -> {value})")
    joined = F.array_join(F.zip_with(F.col(gaps), F.concat(fresh_values, F.array(F.lit(""))), lambda g, v: F.concat(g, v)), "")
    valid = F.coalesce(F.exists(marked, lambda v: v["kind"].isNotNull()), F.lit(False))
    step = step.withColumn(text_col, F.when(valid, joined).otherwise(text))
    if kinds_col is not None:
        names = F.filter(F.transform(F.col(marked), lambda v: v["kind"]), lambda k: k.isNotNull())
        step = step.withColumn(kinds_col, F.coalesce(names, F.array().cast("array<string>")))
    return step.drop(found, gaps, marked)
