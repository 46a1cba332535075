"""Format-preserving pseudonyms for personal data, from keyed Feistel permutations.

A value is taken apart into positions with alphabets (digits, small letters, capitals); the two
halves are numbers of mixed radix, and ten rounds add a keyed hash of one half to the other. Through these
rounds all values of the format lie on one keyed cycle, and the next one on it is the pseudonym: equal values
get equal ones in every document, different ones stay different, none stands for itself, and a pseudonym has
the format of what it replaces. Where only some
values are valid (dates, network addresses, social security numbers) the permutation is walked until
it gives a valid one; check digits of cards and accounts are left out and worked out anew.

Only validated values are replaced: a 16-digit number that fails its check digit stays.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructField, StructType

from curatrix.llm import common

ROUNDS = 10
#: Setting of the session that holds the key. Who knows the key can undo the pseudonyms.
KEY_SETTING = "spark.curatrix.pii.key"
#: The key of the registered queries, which run on made-up tables, where the session has none. No operator falls back on it.
QUERY_KEY = "for made-up tables only"

_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
_PLACE = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}


def _rounds(nums: list[int], sizes: list[int], shape: str, key: bytes, back: bool = False) -> None:
    """The Feistel rounds on the two halves, or the same undone."""
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        x, y = r % 2, 1 - r % 2
        said = int.from_bytes(hashlib.blake2b(f"{shape}/{r}/{nums[y]}".encode(), key=key, digest_size=16).digest())
        nums[x] = (nums[x] - said if back else nums[x] + said) % sizes[x]


def permute(value: str, key: bytes, tweak: str) -> str:
    """The keyed permutation of ``value`` within its format; characters of no alphabet stay.

    The rounds, one step on, and the rounds undone: all values of a format lie on one keyed cycle, so none is
    its own pseudonym (unless its format has no other value)."""
    at = [i for i, c in enumerate(value) if c in _PLACE]
    alphabets = [_PLACE[value[i]][0] for i in at]
    if not at:
        return value
    cut = max(1, len(at) // 2)
    sides = [alphabets[:cut], alphabets[cut:]]
    nums, sizes = [0, 0], [1, 1]
    for side, part in enumerate((at[:cut], at[cut:])):
        for i in part:
            a, d = _PLACE[value[i]]
            nums[side] = nums[side] * len(a) + d
            sizes[side] *= len(a)
    shape = f"{tweak}/{'.'.join(str(len(a)) for a in alphabets)}"
    _rounds(nums, sizes, shape, key)
    nums[1] += 1
    if nums[1] == sizes[1]:
        nums[0], nums[1] = (nums[0] + 1) % sizes[0], 0
    _rounds(nums, sizes, shape, key, back=True)
    out = list(value)
    for side, part in enumerate((at[:cut], at[cut:])):
        n = nums[side]
        for i, a in zip(reversed(part), reversed(sides[side]), strict=True):
            n, d = divmod(n, len(a))
            out[i] = a[d]
    return "".join(out)


def _walk(value: str, key: bytes, tweak: str, valid: Callable[[str], bool]) -> str:
    """Permutes until the result is valid: a permutation of the valid values."""
    out = permute(value, key, tweak)
    while not valid(out):
        out = permute(out, key, tweak)
    return out


def _dealt(shape: str, digits: str) -> str:
    """``digits`` in the places of the letters and digits of ``shape``."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in shape)


# ---------------------------------------------------------------- kinds: pattern, validation, pseudonym


def _luhn(digits: str) -> int:
    """The check digit that belongs after ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _card(m: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or _luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = permute(digits[:-1], key, "card")
    return _dealt(m[0], body + str(_luhn(body)))


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def _iban(m: re.Match, key: bytes) -> str | None:
    plain = m[0].replace(" ", "")
    country, body = plain[:2], plain[4:]
    if not 15 <= len(plain) <= 34 or plain[2:4] != _iban_check(country, body):
        return None
    body = permute(body, key, "iban/" + country)
    return _dealt(m[0], country + _iban_check(country, body) + body)


def _ssn_ok(v: str) -> bool:
    return v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000"


def _ssn(m: re.Match, key: bytes) -> str | None:
    return _walk(m[0], key, "ssn", _ssn_ok) if _ssn_ok(m[0]) else None


_FIRST, _DAYS = dt.date(1900, 1, 1).toordinal(), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days


def _date(m: re.Match, key: bytes) -> str | None:
    parts, sep = re.split(r"([-/.])", m[0])[::2], re.search(r"[-/.]", m[0])[0]
    n = [int(p) for p in parts]
    orders = ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 0, 1), (2, 1, 0)) if sep == "/" else ((2, 1, 0),)
    for order in orders:
        try:
            day = dt.date(*(n[i] for i in order)).toordinal() - _FIRST
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            continue
        new = dt.date.fromordinal(_FIRST + int(_walk(f"{day:05d}", key, "date", lambda v: int(v) < _DAYS)))
        out = [""] * 3
        for i, v in zip(order, (new.year, new.month, new.day), strict=True):
            out[i] = f"{v:0{len(parts[i])}d}"
        return sep.join(out)
    return None


def _ip_ok(v: str) -> bool:
    return int(v) < 1 << 32


def _ip(m: re.Match, key: bytes) -> str | None:
    octets = [int(x) for x in m[0].split(".")]
    if max(octets) > 255:
        return None
    new = int(_walk(f"{int.from_bytes(bytes(octets)):010d}", key, "ip", _ip_ok))
    return ".".join(str(b) for b in new.to_bytes(4))


def _phone(m: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 8 <= len(digits) <= 15:
        return None
    head = re.match(r"\+\d{1,3}(?!\d)|", m[0])[0]  # the country code stays
    return head + permute(m[0][len(head) :], key, "phone")


def _email(m: re.Match, key: bytes) -> str | None:
    local, at, domain = m[0].rpartition("@")
    return permute(local, key, "email/" + domain.lower()) + at + domain


#: In the order in which overlapping findings are decided.
KINDS: tuple[tuple[str, re.Pattern, Callable], ...] = (
    ("email", re.compile(r"(?<![\w.+%@-])[\w+%-][\w.+%-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,24}(?![\w@])"), _email),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{2,4}){3,8}(?!\w)"), _iban),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), _ssn),
    ("date", re.compile(r"(?<![\w./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}([-./])\d{1,2}\1\d{4})(?:(?=T\d\d:)|(?![\w/-]|\.\d))"), _date),
    ("ip", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"), _ip),
    ("card", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)"), _card),
    ("phone", re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-]|\.\d)"), _phone),
)


_LIKELY = re.compile(r"[@0-9]")
_GAP = re.compile(r"[ -]")


#: Lengths of account numbers by country. Fixed values.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28,
    EE=20, EG=29, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26,
    IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18,
    NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SC=31, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23, TN=24,
    TR=26, UA=29, VA=22, VG=24, XK=20,
)


#: Digits of phone numbers with their country code, for countries where all have as many. Fixed values.
PHONE_DIGITS = {"1": 11, "7": 11, "30": 12, "31": 11, "33": 11, "34": 11, "41": 11, "44": 12, "45": 10, "47": 10, "48": 11, "52": 12, "61": 11, "90": 12, "91": 12, "351": 12, "420": 12}


def _matches(kind: str, pattern: re.Pattern, text: str, m: re.Match) -> Iterator[re.Match]:
    """The match and, for kinds that run on over blanks, those of the same start that end at an earlier blank.

    The longest come first, but before all the one of the length that the country prescribes."""
    ends = [m.end()]
    if kind in ("iban", "card", "phone"):
        ends += [m.start() + i for i in range(len(m[0]) - 1, 0, -1) if m[0][i] == " "]
    if kind == "iban" and (length := IBAN_LENGTHS.get(m[0][:2])):
        own = [e for e in ends if len(text[m.start() : e].replace(" ", "")) == length]
        ends = list(dict.fromkeys([*own, m.end()]))
    elif kind == "phone" and m[0][0] == "+":
        digits = re.sub(r"\D", "", m[0])
        length = next((n for c, n in PHONE_DIGITS.items() if digits.startswith(c)), 0)
        ends.sort(key=lambda e: sum(c.isdigit() for c in text[m.start() : e]) != length)
    for end in ends:
        if one := m if end == m.end() else pattern.fullmatch(text, m.start(), end):
            yield one


def findings(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """Validated, non-overlapping (start, end, kind, pseudonym) in the order of the text."""
    out: list[tuple[int, int, str, str]] = []
    if not _LIKELY.search(text):
        return out
    taken = bytearray(len(text))
    for kind, pattern, pseudonym in KINDS:
        if kind == "email" and "@" not in text:
            continue
        at = 0
        while m := pattern.search(text, at):
            new = None
            for one in _matches(kind, pattern, text, m):
                if not any(taken[one.start() : one.end()]) and (new := pseudonym(one, key)) is not None:
                    break
            if new is None:
                # what failed may hide a valid value that begins at its next word
                gap = _GAP.search(text, m.start() + 1, m.end())
                at = gap.end() if kind in ("card", "iban") and gap else m.end()
                continue
            m = one
            out.append((m.start(), m.end(), kind, new))
            taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
            at = m.end()
    return sorted(out)


def _masked(text: str, found: list[tuple[int, int, str, str]]) -> str:
    parts, at = [], 0
    for start, end, _, new in found:
        parts += (text[at:start], new)
        at = end
    return "".join([*parts, text[at:]])


NAMES = tuple(k for k, _, _ in KINDS)
_RESULT = StructType([StructField("text", StringType()), *[StructField(f"n_{k}", LongType()) for k in NAMES], StructField("spans", StringType())])


def pseudonymise(key: str):
    """UDF of a text column: text with pseudonyms, counts by kind, spans (kind:start:end, in the input)."""
    secret = hashlib.blake2b(key.encode()).digest()

    @pandas_udf(_RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            found = findings(t, secret) if t else []
            kinds = [k for _, _, k, _ in found]
            rows.append((_masked(t, found) if found else t, *[kinds.count(k) for k in NAMES], ",".join(f"{k}:{s}:{e}" for s, e, k, _ in found)))
        return pd.DataFrame(rows, columns=[f.name for f in _RESULT])

    return run


def session_key(spark) -> str:
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"a secret key is needed: give one, or set {KEY_SETTING}")
    return key


def query_key(spark) -> str:
    return spark.conf.get(KEY_SETTING, None) or QUERY_KEY


def mask(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; other columns, and null and empty texts, as they are.

    Without ``key`` the session must name one. Very long texts are read whole; repeated rows stay and get
    the same pseudonyms; an empty table stays empty."""
    common.small_batches(docs.sparkSession)
    run = pseudonymise(key or session_key(docs.sparkSession))
    return docs.withColumn(text, run(F.col(text))["text"])


def op6_feistel_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced: doc_id, text, counts by kind, spans.

    Null texts stay null with no findings, empty ones empty; repeated rows get the same result."""
    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    return docs.select("doc_id", pseudonymise(query_key(spark))(F.col("text")).alias("r")).select("doc_id", "r.*")
