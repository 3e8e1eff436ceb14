"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Candidates are found by one pattern and validated (Luhn digit, mod 97, octets, calendar, number ranges). A valid value is
read as a row of symbols, each with the size of its alphabet (a digit 10, a letter the letters of its case and range of
the Unicode table, an octet 256, a fixed sign 1), and permuted by an alternating Feistel network: in each round one half
is shifted, symbol by symbol and modulo the alphabets' sizes, by a SHA-512 keystream of the key, the kind, the round and
the other half, a block of it for every 16 symbols. That is a bijection of the values of one format, so equal values get
equal pseudonyms in every document, and different values different ones. Check digits are computed anew, dates are
permuted as day numbers of the 400 years from 1800, so results are valid again.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import free_name

ROUNDS = 8
#: Symbols that one keystream block serves, with eight hexadecimal digits each.
PER_BLOCK = 16
#: 400 Gregorian years have 146,097 = 189 * 773 days.
FIRST_DAY, DAY_SIZES = "1800-01-01", (189, 773)

EMAIL = r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
KEY = r"A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"
IBAN = r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
IPV6 = r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})(?![\w:])"
PHONE = (
    r"(?<![\w+])(?:\+\d{1,3}(?:[ .-]?\(\d{2,4}\)|[ .-]\d{2,4}|\d{3})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
    r"|(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)|0\d{2,4} \d{3,4} \d{3,4}(?![\d ]*\d))"
)
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
DATE = r"(?<![\w./-])(?:\d{4}(?<d1>[-/.])\d{2}\k<d1>\d{2}|\d{2}(?<d2>[-/.])\d{2}\k<d2>\d{4})(?![\w/-])"
IP = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)(?!\w)"
CARD = r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?<c1>[ -])\d{4}\k<c1>\d{4}\k<c1>\d{1,7}|\d{4}(?<c2>[ -])\d{6}\k<c2>\d{5})(?!\w)"
#: Hexadecimal in small letters or in capitals.
SECRET = r"(?:(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,64}|(?=[0-9A-F]*[0-9])(?=[0-9A-F]*[A-F])[0-9A-F]{32,64})(?![A-Za-z0-9])"
#: In this order of preference where two kinds begin at one place. No kind begins within a run of ASCII letters and
#: digits, which is looked at before all else.
PATTERN = rf"(?<![A-Za-z0-9])(?:{EMAIL}|{KEY}|{IBAN}|(?=[0-9A-Fa-f]){IPV6}|(?=[0-9+(])(?:{PHONE}|{SSN}|{DATE}|{IP}|{CARD})|(?=[0-9A-Fa-f]){SECRET})"
#: A text without any of these has nothing to find.
SCREEN = r"[0-9@]"
#: Parts candidates from the text between them; texts that hold it themselves are cut in two passes.
MARK = "\x01"


# The functions below write SQL expressions: the whole expression is parsed once, where as many column objects would take
# the driver many seconds to build.

_number = count()


def _let(value: str, body: Callable[[str], str]) -> str:
    """body(value) with the value computed once."""
    return f"get({_each(f'array({value})', body)}, 0)"


def _each(values: str, body: Callable[..., str], place: bool = False) -> str:
    """body of every value, and of its place where asked for."""
    x, i = f"x{next(_number)}", f"i{next(_number)}"
    return f"transform({values}, ({x}, {i}) -> {body(x, i)})" if place else f"transform({values}, {x} -> {body(x)})"


def _fold(values: str, start: str, body: Callable[[str, str], str], end: Callable[[str], str] | None = None) -> str:
    a, x = f"a{next(_number)}", f"x{next(_number)}"
    return f"aggregate({values}, {start}, ({a}, {x}) -> {body(a, x)}" + (f", {a} -> {end(a)})" if end else ")")


def _text(value: str) -> str:
    """A literal of any text."""
    return f"decode(unhex('{value.encode().hex()}'), 'UTF-8')"


def _feistel(sym: str, size: str, key: str, kind: str) -> str:
    """Symbols permuted within their alphabets' sizes."""

    def shifted(n: str, own: str, sizes: str, other: str, i: str) -> str:
        seed = f"concat_ws('|', {_text(key)}, '{kind}', string({n}), string({i}), array_join(cast({other} as array<string>), ','))"
        blocks = _each(f"sequence(0, greatest(0, int(ceil(size({own}) / {PER_BLOCK})) - 1))", lambda b: f"sha2(concat_ws('|', {seed}, string({b})), 512)")
        word = lambda s, j: f"bigint(conv(substring({s}, 1 + 8 * {j}, 8), 16, 10))"
        return _let(f"array_join({blocks}, '')", lambda s: _each(own, lambda x, j: f"int(pmod({x} + {word(s, j)}, get({sizes}, {j})))", place=True))

    def network(v: str) -> str:
        n = f"size({v}.s)"
        h = f"int(floor({n} / 2))"
        sl, sr = f"slice({v}.n, 1, {h})", f"slice({v}.n, {h} + 1, {n} - {h})"
        start = f"named_struct('l', slice({v}.s, 1, {h}), 'r', slice({v}.s, {h} + 1, {n} - {h}))"

        def round_(a: str, i: str) -> str:
            left, right = shifted(n, f"{a}.l", sl, f"{a}.r", i), shifted(n, f"{a}.r", sr, f"{a}.l", i)
            return f"if({i} % 2 = 1, named_struct('l', {left}, 'r', {a}.r), named_struct('l', {a}.l, 'r', {right}))"

        return _fold(f"sequence(1, {ROUNDS})", start, round_, lambda a: f"concat({a}.l, {a}.r)")

    return _let(f"named_struct('s', cast({sym} as array<int>), 'n', cast({size} as array<int>))", network)


def _sign(c: str, at: str, n: str, lo: str, step: str = "1", abc: str = "null") -> str:
    return f"named_struct('c', {c}, 'at', int({at}), 'n', int({n}), 'lo', int({lo}), 'step', int({step}), 'abc', string({abc}))"


def _among(c: str, lo: str, n: str) -> str:
    """The place of the sign c in an alphabet of n signs from code lo on."""
    return _let(f"named_struct('lo', {lo}, 'n', {n})", lambda v: _sign(c, f"if({v}.n > 1, ascii({c}) - {v}.lo, 0)", f"{v}.n", f"{v}.lo"))


def _by_signs(text: str, key: str, kind: str, alphabet: Callable[[str, str, str], str]) -> str:
    """Permute a text sign by sign, each within its alphabet; alphabets of one sign keep it.

    alphabet gives a sign's struct of itself, its place, and the number of signs, the first sign's code and the codes
    between two signs; where it gives a text abc, the signs are those of the text.
    """

    def shown(p: str, m: str) -> str:
        code = f"({p}.lo + {m} * {p}.step)"
        char = f"if({code} < 128, char({code}), decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32'))"
        return f"case when {p}.n <= 1 then {p}.c when {p}.abc is not null then substring({p}.abc, {m} + 1, 1) else {char} end"

    def moved(plan: str) -> str:
        new = _feistel(_each(plan, lambda p: f"{p}.at"), _each(plan, lambda p: f"{p}.n"), key, kind)
        p, m = f"x{next(_number)}", f"x{next(_number)}"
        return f"array_join(zip_with({plan}, {new}, ({p}, {m}) -> {shown(p, m)}), '')"

    return _let(f"split({text}, '')", lambda signs: _let(_each(signs, lambda c, j: alphabet(c, j, signs), place=True), moved))


@cache
def _unicode_alphabets() -> tuple[list[tuple[int, int, int]], list[str]]:
    """Letters and digits beyond ASCII by category: even runs (first, number, step), and for each category the rest."""
    kinds: dict[str, list[int]] = {}
    for code in range(128, 0x32400):
        kind = unicodedata.category(chr(code))
        if kind[0] in "LN":
            kinds.setdefault(kind, []).append(code)
    runs, rest = [], []
    for codes in kinds.values():
        left, i = [], 0
        while i < len(codes):
            j, step = i + 1, codes[i + 1] - codes[i] if i + 1 < len(codes) else 1
            while j < len(codes) and step <= 2 and codes[j] - codes[j - 1] == step:
                j += 1
            if j - i >= 8:
                runs.append((codes[i], j - i, step))
            else:
                left += codes[i:j]
            i = j
        rest.append("".join(map(chr, left)))
    return sorted(runs), sorted(filter(None, rest))


def _ascii(letters: int = 26) -> Callable[[str, str, str], str]:
    """Digits, capitals and small letters, the first `letters` of the alphabet; all else is kept."""

    def alphabet(c: str, j: str, signs: str) -> str:
        classes = ((48, 10), (65, letters), (97, letters))
        ladder = lambda which: " ".join(f"when ascii({c}) between {x[0]} and {x[0] + x[1] - 1} then {x[which]}" for x in classes)
        return _among(c, f"case {ladder(0)} else 0 end", f"case {ladder(1)} else 1 end")

    return alphabet


def _any_script(c: str, j: str, signs: str) -> str:
    """Letters and digits of all scripts; a letter stays among those of its case and kind."""
    runs, rest = _unicode_alphabets()
    numbers = lambda i: f"cast(split('{','.join(str(r[i]) for r in runs)}', ',') as array<int>)"
    rows = f"arrays_zip({numbers(0)}, {numbers(1)}, {numbers(2)})"
    others = f"array({','.join(map(_text, rest))})"
    r, o, a = f"x{next(_number)}", f"x{next(_number)}", f"ascii({c})"
    inside = f"{r} -> {a} between {r}.`0` and {r}.`0` + ({r}.`1` - 1) * {r}.`2` and ({a} - {r}.`0`) % {r}.`2` = 0"
    of_run = lambda r: f"if({r} is null, null, {_sign(c, f'({a} - {r}.`0`) div {r}.`2`', f'{r}.`1`', f'{r}.`0`', f'{r}.`2`')})"
    of_rest = lambda o: _sign(c, f"if({o} is null, 0, instr({o}, {c}) - 1)", f"coalesce(length({o}), 1)", "0", "1", o)
    beyond = f"coalesce({_let(f'get(filter({rows}, {inside}), 0)', of_run)}, {_let(f'get(filter({others}, {o} -> contains({o}, {c})), 0)', of_rest)})"
    return f"if({a} < 128, {_ascii()(c, j, signs)}, {beyond})"


def _digits_from(first: str) -> Callable[[str, str, str], str]:
    """Digits from a place on; the first digit of a group stays among 0-1 or 2-9."""

    def alphabet(c: str, j: str, signs: str) -> str:
        digit = f"(ascii({c}) between 48 and 57 and {j} >= {first})"
        leads = f"({j} = 0 or not coalesce(ascii(get({signs}, {j} - 1)) between 48 and 57, false))"
        high = f"{digit} and {leads} and ascii({c}) >= 50"
        return _among(c, f"case when {high} then 50 when {digit} then 48 else 0 end", f"case when {high} then 8 when {digit} and {leads} then 2 when {digit} then 10 else 1 end")

    return alphabet


def _luhn_sum(digits: str, from_right: int) -> str:
    """Luhn sum of a digit string whose last digit has the given place from the right (0: the check digit's)."""
    value = lambda c, i: f"if(({i} + {from_right}) % 2 = 0, int({c}), int({c}) * 2 - if(int({c}) >= 5, 9, 0))"
    return _fold(_each(f"reverse(split({digits}, ''))", value, place=True), "0", lambda a, x: f"{a} + {x}")


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _card(m: str, key: str) -> str:
    def alphabet(c: str, j: str, signs: str) -> str:
        first, digit = f"{j} = 0 and ascii({c}) between 49 and 57", f"ascii({c}) between 48 and 57"
        return _among(c, f"case when {first} then 49 when {digit} then 48 else 0 end", f"case when {first} then 9 when {j} = 0 then 1 when {digit} then 10 else 1 end")

    check = lambda b: f"string(pmod(10 - {_luhn_sum(_digits(b), 1)} % 10, 10))"
    body = _let(_by_signs(f"substring({m}, 1, length({m}) - 1)", key, "card", alphabet), lambda b: f"concat({b}, {check(b)})")
    return f"if({_luhn_sum(_digits(m), 0)} % 10 = 0 and {m} rlike '[1-9]', {body}, null)"


def _mod_97(signs: str) -> str:
    """A row of digits and capitals (A is 10) as one number, modulo 97."""
    return _fold(f"split({signs}, '')", "0", lambda a, c: f"if(ascii({c}) < 58, {a} * 10 + ascii({c}) - 48, {a} * 100 + ascii({c}) - 55) % 97")


def _iban(m: str, key: str) -> str:
    country, check, account = f"substring({m}, 1, 2)", f"substring({m}, 3, 2)", f"substring({m}, 5)"
    rest = lambda x, digits: _mod_97(f"concat(replace({x}, ' ', ''), {country}, {digits})")
    new = _let(_by_signs(account, key, "iban", _ascii()), lambda x: f"concat({country}, lpad(string(98 - {rest(x, repr('00'))}), 2, '0'), {x})")
    return f"if({rest(account, check)} = 1 and int({check}) between 2 and 98, {new}, null)"


def _ipv6(m: str, key: str) -> str:
    groups = f"size(filter(split({m}, ':'), g -> g <> ''))"
    valid = f"{m} rlike '[0-9]' and if(contains({m}, '::'), {groups} between 4 and 7, {groups} = 8)"
    return f"if({valid}, {_by_signs(m, key, 'ipv6', _ascii(6))}, null)"


def _ip(m: str, key: str) -> str:
    moved = lambda o: f"array_join(cast({_feistel(o, 'array(256, 256, 256, 256)', key, 'ip')} as array<string>), '.')"
    return _let(f"cast(split({m}, '[.]') as array<int>)", lambda o: f"if(forall({o}, q -> q <= 255), {moved(o)}, null)")


def _ssn(m: str, key: str) -> str:
    def moved(p: str) -> str:
        valid = f"{p}[0] between 1 and 899 and {p}[0] <> 666 and {p}[1] > 0 and {p}[2] > 0"
        new = _feistel(f"array({p}[0] - 1 - int({p}[0] > 666), {p}[1] - 1, {p}[2] - 1)", "array(898, 99, 9999)", key, "ssn")
        shown = lambda x: f"format_string('%03d-%02d-%04d', {x}[0] + 1 + int({x}[0] + 1 >= 666), {x}[1] + 1, {x}[2] + 1)"
        return f"if({valid}, {_let(new, shown)}, null)"

    return _let(f"cast(split({m}, '-') as array<int>)", moved)


def _date(m: str, key: str) -> str:
    year_first = f"{m} rlike '^[0-9]{{4}}'"
    sep = f"if({year_first}, substring({m}, 5, 1), substring({m}, 3, 1))"
    # where year, month and day stand
    order = f"case when {year_first} then array(0, 1, 2) when {sep} = '/' then array(2, 0, 1) else array(2, 1, 0) end"
    a, b = DAY_SIZES

    def shown(o: str, x: str) -> str:
        new = f"split(date_format(date_add(date'{FIRST_DAY}', {x}[0] * {b} + {x}[1]), 'yyyy-MM-dd'), '-')"
        at = [f"get({new}, int(array_position({o}, {i})) - 1)" for i in range(3)]
        return f"concat_ws({sep}, {', '.join(at)})"

    def moved(o: str) -> str:
        at = [f"get(split({m}, '[-/.]'), {o}[{i}])" for i in range(3)]
        day = f"try_to_date(concat_ws('-', {', '.join(at)}), 'yyyy-MM-dd')"
        new = lambda n: _let(_feistel(f"array(int({n} div {b}), {n} % {b})", f"array({a}, {b})", key, "date"), lambda x: shown(o, x))
        return _let(f"datediff({day}, date'{FIRST_DAY}')", lambda n: f"if({n} between 0 and {a * b - 1}, {new(n)}, null)")

    return _let(order, moved)


def _phone(m: str, key: str) -> str:
    """Digits after the country's code or the trunk zero."""
    kept = f"length(regexp_extract({m}, '^(?:[+](?:[0-9]{{1,3}}(?=[ .(-])|[0-9])|0)', 0))"
    return f"if(length({_digits(m)}) between 8 and 15, {_by_signs(m, key, 'phone', _digits_from(kept))}, null)"


def _email(m: str, key: str) -> str:
    """All but the top-level domain."""
    body = f"length({m}) - length(substring_index({m}, '.', -1)) - 1"
    return f"concat({_by_signs(f'substring({m}, 1, {body})', key, 'email', _any_script)}, substring({m}, {body} + 1))"


def pseudonym(m: str, key: str) -> str:
    """SQL of the pseudonym of the candidate m, null where that is not valid."""
    kinds = (
        ("@", _email(m, key)),
        (r"^A[KS]IA[A-Z0-9]{16}$", f"concat(substring({m}, 1, 4), {_by_signs(f'substring({m}, 5)', key, 'key', _ascii())})"),
        (r"^[A-Z]{2}\d{2}[A-Z0-9 ]{11,}$", _iban(m, key)),
        (":", _ipv6(m, key)),
        (r"^(?=.*[a-fA-F])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})$", _by_signs(m, key, "secret", _ascii(6))),
        (r"^\d{3}-\d{2}-\d{4}$", _ssn(m, key)),
        (r"^(?:\d{4}[-/.]\d{2}[-/.]\d{2}|\d{2}[-/.]\d{2}[-/.]\d{4})$", _date(m, key)),
        (r"^\d{1,3}(?:\.\d{1,3}){3}$", _ip(m, key)),
        (r"^(?:\+|\()|^\d{3}[.-]\d{3}[.-]\d{4}$|^0\d{2,4} \d{3,4} \d{3,4}$", _phone(m, key)),
    )
    return "case " + " ".join(f"when {m} rlike r'{k}' then {v}" for k, v in kinds) + f" else {_card(m, key)} end"


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """All columns of df, with personal data in text_col replaced; count_col, if named, gets the number replaced.

    Null texts stay null with count 0; text without a valid value is unchanged, as is everything around a value. Slash
    dates are month first, others year first or day first; dates outside 1800-2199 and invalid numbers stay. The count
    is that of valid values, including one whose pseudonym happens to be itself. A column of df named count_col is
    replaced. No shuffle and no Python: candidates are marked in one pass, texts are cut at the marks, and the pieces
    joined with the pseudonyms in place of the candidates.
    """
    text = F.col(text_col).cast("string")
    parts, names = free_name(df, "_parts"), free_name(df, "_names")
    twice = F.flatten(F.zip_with(F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda g, h: F.array(g, h)))
    cut = F.when(text.contains(MARK), twice).otherwise(F.split(F.regexp_replace(text, PATTERN, f"{MARK}$0{MARK}"), MARK, -1))
    found = df.withColumn(parts, F.when(text.rlike(SCREEN), cut))
    found = found.withColumn(names, F.expr(f"transform(`{parts}`, (p, i) -> if(i % 2 = 1, {pseudonym('p', key)}, null))"))
    whole = F.array_join(F.zip_with(F.col(parts), F.col(names), lambda p, n: F.coalesce(n, p)), "")
    columns = [F.when(F.size(parts) > 1, whole).otherwise(text).alias(c) if c == text_col else F.col(c) for c in df.columns if c != count_col]
    if count_col:
        columns.append(F.coalesce(F.size(F.filter(names, lambda n: n.isNotNull())), F.lit(0)).alias(count_col))
    return found.select(*columns)
