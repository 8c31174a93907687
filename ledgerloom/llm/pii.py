"""Format-preserving pseudonyms by a keyed Feistel permutation.

Values that pass their format's check (card and account check digits, calendar dates, number plans)
are mapped one to one onto values of the same format. The same value gets the same pseudonym in
every document, so links survive; without the key they cannot be undone. Lengths never change.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table

ROUNDS = 10
KEY_SETTING = "spark.ledgerloom.pii.key"
SAMPLE_KEY = "set spark.ledgerloom.pii.key to a secret"
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY

PATTERN = re.compile(
    r"""(?P<email>(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
    |(?P<aws>(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9]))
    |(?P<secret>(?<![A-Za-z0-9])(?i:password|passwd|secret|token|api_key)\ ?[=:]\ ?["']?(?P<value>[A-Za-z0-9]{12,})(?![A-Za-z0-9]))
    |(?P<phone>(?<![\w+])\+1[ -]\(?(?P<area>[2-9]\d\d)\)?[ -]?(?P<exchange>[2-9]\d\d)[ -]?(?P<line>\d{4})(?!\d)
      |(?<![\w+])\+\d{1,3}(?:[ -]?\(?\d{1,4}\)?){2,5}(?![\w-]))
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d\d(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?P<date>(?<![\w.,/-])(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d[./]\d\d[./]\d{4})(?![\w/-]))
    |(?P<ssn>(?<![\w.-])\d{3}-\d\d-\d{4}(?![\w-]))
    |(?P<ip>(?<![\w.-])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w-]|\.\d))
    |(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))""",
    re.VERBOSE,
)
HINT = re.compile(r"[0-9@]|AKIA|ASIA|(?i:password|passwd|secret|token|api_key)")
DIGITS, UPPER, LOWER = string.digits, string.ascii_uppercase, string.ascii_lowercase


def permute(value: int, size: int, key: bytes, kind: str) -> int:
    """A keyed permutation of 0 … size-1: Feistel rounds on the bits, walked until in range."""
    bits = max(2, (size - 1).bit_length())
    low_bits = bits // 2
    low_mask, high_mask = (1 << low_bits) - 1, (1 << (bits - low_bits)) - 1
    width = bits // 8 + 1
    person = f"{kind}:{size}".encode()
    while True:
        high, low = value >> low_bits, value & low_mask
        for number in range(ROUNDS):
            source = low if number % 2 else high
            mixed = hashlib.blake2b(
                person + bytes([number]) + source.to_bytes(width, "big"), key=key, digest_size=32
            ).digest()
            noise = int.from_bytes(mixed, "big") if width <= 32 else _stretch(mixed, width)
            if number % 2:
                high ^= noise & high_mask
            else:
                low ^= noise & low_mask
        value = high << low_bits | low
        if value < size:
            return value


def _stretch(seed: bytes, width: int) -> int:
    return int.from_bytes(hashlib.shake_256(seed).digest(width), "big")


def _by_radix(digits: list[int], sizes: list[int], key: bytes, kind: str) -> list[int]:
    """Permutes a mixed-radix number."""
    number, total = 0, 1
    for digit, size in zip(digits, sizes):
        number, total = number * size + digit, total * size
    number = permute(number, total, key, kind)
    out = []
    for size in reversed(sizes):
        number, digit = divmod(number, size)
        out.append(digit)
    return out[::-1]


def _characters(text: str, key: bytes, kind: str) -> str:
    """Digits to digits, capitals to capitals, small letters to small letters; the rest stays."""
    classes = [next((c for c in (DIGITS, UPPER, LOWER) if ch in c), None) for ch in text]
    places = [i for i, c in enumerate(classes) if c]
    if not places:
        return text
    shape = "".join("9" if c is DIGITS else "A" if c is UPPER else "a" if c is LOWER else ch for ch, c in zip(text, classes))
    new = _by_radix([classes[i].index(text[i]) for i in places], [len(classes[i]) for i in places], key, f"{kind}:{shape}")
    out = list(text)
    for i, digit in zip(places, new):
        out[i] = classes[i][digit]
    return "".join(out)


def _refill(shape: str, characters: str) -> str:
    """Puts characters in the places of the letters and digits of ``shape``."""
    left = iter(characters)
    return "".join(next(left) if ch.isalnum() else ch for ch in shape)


def luhn_digit(digits: str) -> str:
    """The check digit of a card number without it."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _email(text: str, match: re.Match, key: bytes) -> str:
    name, _, host = text.partition("@")
    return f"{_characters(name, key, 'email')}@{host}"


def _aws(text: str, match: re.Match, key: bytes) -> str:
    return text[:4] + _characters(text[4:], key, "aws")


def _secret(text: str, match: re.Match, key: bytes) -> str:
    value = match["value"]
    head = len(text) - len(value)
    if set(value) <= set(string.hexdigits.lower()):
        new = _by_radix([int(c, 16) for c in value], [16] * len(value), key, "hex")
        return text[:head] + "".join(f"{d:x}" for d in new)
    return text[:head] + _characters(value, key, "secret")


def _phone(text: str, match: re.Match, key: bytes) -> str | None:
    digits = "".join(filter(str.isdigit, text))
    if not 8 <= len(digits) <= 15:
        return None
    country = re.match(r"\+\d+", text).group()[1:][:3]
    rest = digits[len(country) :]
    if country == "1":
        if len(rest) != 10:
            return None
        if _planned(rest):
            new = _by_radix([int(rest[:3]) - 200, int(rest[3:6]) - 200, int(rest[6:])], [800, 800, 10_000], key, "phone")
            return _refill(text, f"1{new[0] + 200}{new[1] + 200}{new[2]:04d}")
    new = permute(int(rest), 10 ** len(rest), key, f"phone:{country}") if rest else 0
    # Numbers outside the plan stay outside, so that no two numbers share a pseudonym.
    while country == "1" and _planned(f"{new:010d}"):
        new = permute(new, 10 ** len(rest), key, f"phone:{country}")
    return _refill(text, country + (f"{new:0{len(rest)}d}" if rest else ""))


def _planned(rest: str) -> bool:
    """Whether area and exchange are those of the North American plan."""
    return rest[0] >= "2" and rest[3] >= "2"


def _iban(text: str, match: re.Match, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = _characters(plain[4:], key, f"iban:{plain[:2]}")
    check = 98 - _mod97(body + plain[:2] + "00")
    return _refill(text, f"{plain[:2]}{check:02d}{body}")


def _date(text: str, match: re.Match, key: bytes) -> str | None:
    mark = text[4] if text[:4].isdigit() else text[2]
    if text[:4].isdigit():
        layouts = [f"%Y{mark}%m{mark}%d"]
    else:  # day first, unless it can only be month first
        layouts = [f"%d{mark}%m{mark}%Y", f"%m{mark}%d{mark}%Y"]
    for layout in layouts:
        try:
            day = datetime.datetime.strptime(text, layout).date().toordinal() - FIRST_DAY
        except ValueError:
            continue
        if 0 <= day < DAYS:
            # Month-first values form a format of their own: those whose day exceeds 12.
            kind = "date" if layout == layouts[0] else "date:month-first"
            while True:
                day = permute(day, DAYS, key, kind)
                new = datetime.date.fromordinal(FIRST_DAY + day)
                if layout == layouts[0] or new.day > 12:
                    return new.strftime(layout)
    return None


def _ssn(text: str, match: re.Match, key: bytes) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    place = area - 1 - (area > 666)
    new = _by_radix([place, group - 1, serial - 1], [898, 99, 9999], key, "ssn")
    area = new[0] + 1 + (new[0] >= 665)
    return f"{area:03d}-{new[1] + 1:02d}-{new[2] + 1:04d}"


def _ip(text: str, match: re.Match, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    starts = {1: 0, 2: 10, 3: 100}
    sizes = {1: 10, 2: 90, 3: 156}
    lengths = [len(p) for p in parts]
    shape = ".".join(map(str, lengths))
    digits = [int(p) - starts[n] for p, n in zip(parts, lengths)]
    new = _by_radix(digits, [sizes[n] for n in lengths], key, f"ip:{shape}")
    return ".".join(str(d + starts[n]) for d, n in zip(new, lengths))


def _card(text: str, match: re.Match, key: bytes) -> str | None:
    digits = "".join(filter(str.isdigit, text))
    if luhn_digit(digits[:-1]) != digits[-1] or digits[0] == "0":
        return None
    body = digits[1:-1]
    new = permute(int(body), 10 ** len(body), key, f"card:{digits[0]}")
    head = f"{digits[0]}{new:0{len(body)}d}"
    return _refill(text, head + luhn_digit(head))


KINDS = {
    "email": _email,
    "aws": _aws,
    "secret": _secret,
    "phone": _phone,
    "iban": _iban,
    "date": _date,
    "ssn": _ssn,
    "ip": _ip,
    "card": _card,
}


# Kinds whose greedy match may take in characters of what follows, and their least length.
SHORTER = {"phone": 9, "iban": 15, "card": 13}
# Each kind alone, for values at a place where the first kind that matches fails its check.
ALONE = {
    kind: re.compile(f"(?:{part})", re.VERBOSE)
    for kind, part in zip(KINDS, re.split(r"\n    \|(?=\(\?P<)", PATTERN.pattern), strict=True)
}


def _valid(text: str, match: re.Match, key: bytes) -> tuple[str, int, str] | None:
    """Kind, length and pseudonym of the value that starts where ``match`` does: the longest of the
    first kind whose check it passes."""
    begin, first = match.start(), next(k for k in KINDS if match[k])
    kinds = list(KINDS)
    for kind in kinds[kinds.index(first) :]:
        tried = match if kind == first else ALONE[kind].match(text, begin)
        while tried:
            new = KINDS[kind](tried.group(), tried, key)
            if new is not None and not (kind == "card" and _holds_other(text, tried, key)):
                return kind, tried.end() - begin, new
            tried = _shorter(text, tried, kind)
    return None


def _holds_other(text: str, match: re.Match, key: bytes) -> bool:
    """Whether a valid date or social security number starts behind a blank of a card number."""
    for place in range(match.start() + 1, match.end()):
        for kind in ("date", "ssn") if text[place - 1] == " " else ():
            inner = ALONE[kind].match(text, place)
            if inner and KINDS[kind](inner.group(), inner, key) is not None:
                return True
    return False


def _shorter(text: str, match: re.Match, kind: str) -> re.Match | None:
    """The next shorter match of a kind, which ends before a gap: no value ends within a run."""
    for end in range(match.end() - 1, match.start() + SHORTER.get(kind, len(text)) - 1, -1):
        if text[end] in " -" and text[end - 1] not in " -":
            # Cut at the gap, so that only what comes before it can match.
            found = ALONE[kind].fullmatch(text, match.start(), end)
            if found:
                return found
    return None


def pseudonymise(text: str, key: bytes) -> tuple[str, list[dict]]:
    """The text with its values replaced, and their places: start, length, kind."""
    if not HINT.search(text):
        return text, []
    out, spans, end, at = [], [], 0, 0
    while match := PATTERN.search(text, at):
        begin = match.start()
        found = _valid(text, match, key)
        if found is None:
            at = begin + 1
            continue
        kind, length, new = found
        out += [text[end:begin], new]
        spans.append({"start": begin, "length": length, "kind": kind})
        at = end = begin + length
    return "".join([*out, text[end:]]), spans


@functools.lru_cache(4)
def _key(secret: str) -> bytes:
    return hashlib.sha256(secret.encode()).digest()


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("kind", pa.string())]))


def _replace(batches: Iterator[pa.RecordBatch], secret: str) -> Iterator[pa.RecordBatch]:
    key = _key(secret)
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            part = batch.slice(begin, 512)
            done = [(None, []) if t is None else pseudonymise(t, key) for t in part["text"].to_pylist()]
            arrays = [part["row"], pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], SPANS)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "text", "spans"])


def replace_personal_data(docs: DataFrame, secret: str, spans_as: str = "pii_spans") -> DataFrame:
    """``docs`` with ``text`` replaced, and last ``spans_as``: start, length and kind of each value.

    One row per row, no shuffle; all other columns are passed through untouched, an existing
    ``spans_as`` is replaced. NULL texts stay NULL with no spans. Values that fail their check stay.
    """
    others = [c for c in docs.columns if c not in ("text", spans_as)]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others])
    nested = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nested.schema["row"].dataType)
    spans = "array<struct<start: bigint, length: bigint, kind: string>>"
    done = in_arrow(nested, lambda b: _replace(b, secret), f"row struct<{kind.replace('` ', '`: ')}>, text string, spans {spans}")
    columns = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c != spans_as]
    return done.select(*columns, F.col("spans").alias(spans_as))


def secret_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, SAMPLE_KEY)


def op9_pii_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return replace_personal_data(docs, secret_of(spark)).withColumn("n_replaced", F.size("pii_spans"))
