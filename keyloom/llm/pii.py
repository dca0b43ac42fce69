"""Personal data by candidate gradient boosting, with DataFrame and SQL functions only.

High-recall generators (regular expressions) propose spans of every kind, and they may overlap. One
model of boosted trees scores each proposal by its format and by the words around it. A proposal is
taken where its score reaches the threshold of its kind, calibrated on held-out proposals for
high precision. Of proposals that overlap, one gives way to another with a higher score. The four
base kinds are fixed by format and by checks (parts of an address at most 255, Luhn, number of
digits): they are always kept and come before all others, and what their checks refuse is proposed again as
other kinds, by format.

Trees are fitted on the driver from generated texts, in which personal data and things that look like it (order
numbers, versions, prices, dates, digests) are placed by templates; a proposal is a positive if it
covers what was placed as personal data of its kind. The label comes from the template, not from the features. In
SQL the trees are expressions.

Positions are code points. What a pattern leaves between its matches (``split``) and the matches
(``regexp_extract_all``) have lengths whose running sums are all starts and ends; sums run in blocks,
so a text with very many matches takes about linear time. Patterns use possessive loops,
which Java runs without recursion, and look behind them so that a long run is tried once.

Defined results: a null text counts as empty and has no spans. Whole texts are searched, whatever their length.
Of equal scores the earlier span, then the kind listed first, wins. Repeated rows get equal results. Extra columns of
the input are dropped; columns named like the results do not clash. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.boosting import Boosted, boost

#: Fixed by the contract: base kinds in their order. \G admits a run that starts where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that only the trees select.
ADDED = {
    "id": r"(?<![A-Za-z0-9-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![A-Za-z0-9-])",
    "tel": r"(?<![A-Za-z0-9+.-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}(?![A-Za-z0-9]|[.-][0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,256}+(?![A-Za-z0-9_/+-])",
    "account": r"(?<![A-Za-z0-9.,-])[0-9](?:[\x20-]?[0-9]){6,19}(?![A-Za-z0-9]|[.,-][0-9])",
}
KINDS = [*BASE, *ADDED]
#: Code points before and after a span that features see, as far as the next proposal of its kind.
BEFORE, AFTER = 32, 12
#: Words around a span, as one pattern for each feature.
CONTEXT = {
    "id_word": r"\b(?:ssn|social security|national id|identity|passport|tax id|insurance)\b",
    "tel_word": r"\b(?:phone|tel|telephone|call|fax|mobile|cell|contact|ring|dial|text)\b",
    "bank_word": r"\b(?:iban|account|acct|bank|transfer|swift|card|visa|routing)\b",
    "mail_word": r"\b(?:e-?mail|mail|write|reach|address|contact)\b",
    "secret_word": r"(?:token|secret|passw(?:or)?d|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer|auth)",
    "other_word": r"\b(?:part|order|version|model|isbn|item|serial|page|ref|score|lot|case|no|sum|total|price|year|sha1|sha256|md5|commit|checksum|digest|hash|build|ticket|invoice|row|id of)\b",
}
#: Numbers that no national id has.
NEVER_ID = r"^(?:000|666|9[0-9][0-9])[^0-9]|[^0-9]00[^0-9]|[^0-9]0000$"
CALENDAR = r"^(?:19|20)[0-9]{2}[-./\x20]|[-./\x20](?:19|20)[0-9]{2}$"
FEATURES = ["kind", "size", "digits", "upper", "lower", "signs", "turns", "mixed", "paren", "hexed", "assigned", "quoted", "money", "glued", *CONTEXT, "never_id", "calendar", "checked"]

SPAN = "array<struct<start:int,kind:int,end:int,hit:string,score:double>>"
#: Elements a fold copies at once.
RUN = 256


def _literal(pattern: str) -> str:
    """A pattern as a raw SQL string."""
    if '"' not in pattern:
        return f'r"{pattern}"'
    assert "'" not in pattern
    return f"r'{pattern}'"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    return f"aggregate(transform(sequence(1, length({digits})), at -> CAST(substring({digits}, length({digits}) - at + 1, 1) AS INT) * (2 - at % 2) - IF(at % 2 = 0 AND CAST(substring({digits}, length({digits}) - at + 1, 1) AS INT) > 4, 9, 0)), 0, (total, d) -> total + d) % 10 = 0"


def _valid(kind: str, x: str) -> str:
    """The check of a base kind on the matched text ``x``; exact, with no conversion that may overflow."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return f"{x} RLIKE {_literal(f'^{part}(?:[.]{part}){{3}}$')}"
    if kind == "phone":
        return f"length({_digits(x)}) BETWEEN 9 AND 15"
    if kind == "card":
        return f"IF(length({_digits(x)}) BETWEEN 12 AND 19, {_luhn(_digits(x))}, false)"
    return "true" if kind in BASE else "false"


# --- folds over long arrays ----------------------------------------------------------------------


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _before(numbers: str, step: str, zero: str = "0") -> str:
    """For each of an array's ``numbers`` the fold ``step`` of (acc, x) over those before it, and over all as the last.

    Runs of RUN elements are folded on their own, then their totals, so copies stay few.
    """
    parts = f"transform(sequence(0, greatest(size(n) - 1, 0) div {RUN}), b -> slice(n, b * {RUN} + 1, {RUN}))"
    inner = f"transform({parts}, c -> aggregate(c, array({zero}), (a, y) -> array_append(a, {step.replace('acc', 'element_at(a, -1)').replace('x', 'y')})))"
    carry = f"aggregate(p, array({zero}), (a, y) -> array_append(a, {step.replace('acc', 'element_at(a, -1)').replace('x', 'element_at(y, -1)')}))"
    joined = f"flatten(zip_with(p, slice(o, 1, size(p)), (c, h) -> transform(slice(c, 1, size(c) - 1), v -> {step.replace('acc', 'h').replace('x', 'v')})))"
    return _bound(numbers, "n", _bound(inner, "p", _bound(carry, "o", f"array_append({joined}, element_at(o, -1))")))


SUM, MOST = "(acc + x)", "greatest(acc, x)"


def _proposals(kind: str, pattern: str, text: str, hits: str) -> str:
    """All matches of a kind with their place, what lies around them, and whether a base check passes."""
    gaps = f"split({text}, {_literal(pattern)}, -1)"
    starts = _before(f"zip_with({hits}, slice(g, 1, size({hits})), (h, y) -> length(h) + length(y))", SUM)
    one = f"struct(CAST(element_at(s, i) + length(element_at(g, i)) AS INT) AS start, {KINDS.index(kind)} AS kind, CAST(element_at(s, i + 1) AS INT) AS end, element_at({hits}, i) AS hit, right(element_at(g, i), {BEFORE}) AS before, left(element_at(g, i + 1), {AFTER}) AS after, {_valid(kind, f'element_at({hits}, i)')} AS base)"
    made = _bound(gaps, "g", _bound(starts, "s", f"transform(sequence(1, size({hits})), i -> {one})"))
    return f"CASE WHEN size({hits}) > 0 THEN {made} ELSE CAST(array() AS array<struct<start:int,kind:int,end:int,hit:string,before:string,after:string,base:boolean>>) END"


# --- features ------------------------------------------------------------------------------------


def _luhn_of(digits: str) -> bool:
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def features(kind: str, hit: str, before: str, after: str) -> list[float]:
    """The features in Python, for fitting; ``_feature_sql`` computes the same."""
    count = lambda p: len(re.findall(p, hit))
    near = f"{before} {after}".lower()
    digits = re.sub("[^0-9]", "", hit)
    if kind == "iban":
        x = hit.replace(" ", "")
        checked = int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    else:
        checked = kind in ("card", "account") and 12 <= len(digits) <= 19 and _luhn_of(digits)
    return [
        KINDS.index(kind), len(hit), count("[0-9]"), count("[A-Z]"), count("[a-z]"), count("[^A-Za-z0-9]"), count("[A-Za-z][0-9]|[0-9][A-Za-z]"),
        float(len(set(re.findall("[./-]", hit))) > 1), float("(" in hit), float(bool(re.search("^(?:[0-9a-f]+|[0-9A-F]+)$", hit))),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))), float(bool(re.search("[\"']$", before))), float(bool(re.search(r"[$€£]\s?$", before) or re.search(r"^\s?[$€£%]", after))), float(bool(re.search(r"\w$", before) or re.search(r"^\w", after))),
        *(float(bool(re.search(p, near))) for p in CONTEXT.values()),
        float(bool(re.search(NEVER_ID, hit))), float(bool(re.search(CALENDAR, hit))), float(checked),
    ]


def _feature_sql(s: str) -> dict[str, str]:
    hit, before, after = f"{s}.hit", f"{s}.before", f"{s}.after"
    kept = lambda p: f"length(regexp_replace({hit}, {_literal(p)}, ''))"
    test = lambda *p: "IF(" + " OR ".join(f"{x} RLIKE {_literal(q)}" for x, q in p) + ", 1, 0)"
    near = f"lower(concat({before}, ' ', {after}))"
    code = "IF(ascii(c) >= 65, (r * 100 + ascii(c) - 55) % 97, (r * 10 + ascii(c) - 48) % 97)"
    iban = f"aggregate(regexp_extract_all(concat(substring(replace({hit}, ' ', ''), 5), substring(replace({hit}, ' ', ''), 1, 4)), '.', 0), 0, (r, c) -> {code}) = 1"
    out = {
        "kind": f"{s}.kind", "size": f"length({hit})", "digits": kept("[^0-9]"), "upper": kept("[^A-Z]"), "lower": kept("[^a-z]"), "signs": kept("[A-Za-z0-9]"), "turns": f"size(regexp_extract_all({hit}, '[A-Za-z][0-9]|[0-9][A-Za-z]', 0))",
        "mixed": f"IF(CAST(contains({hit}, '.') AS INT) + CAST(contains({hit}, '/') AS INT) + CAST(contains({hit}, '-') AS INT) > 1, 1, 0)", "paren": f"IF(contains({hit}, '('), 1, 0)", "hexed": test((hit, "^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "assigned": test((before, r"[:=]\s*[\x22\x27]?$")), "quoted": test((before, r"[\x22\x27]$")), "money": test((before, r"[$€£]\s?$"), (after, r"^\s?[$€£%]")), "glued": test((before, r"(?U)\w$"), (after, r"(?U)^\w")),
    }
    out |= {name: test((near, p)) for name, p in CONTEXT.items()}
    digits = _digits(hit)
    return out | {"never_id": test((hit, NEVER_ID)), "calendar": test((hit, CALENDAR)), "checked": f"CASE WHEN {s}.kind = {KINDS.index('iban')} THEN IF({iban}, 1, 0) WHEN {s}.kind IN ({KINDS.index('card')}, {KINDS.index('account')}) AND length({digits}) BETWEEN 12 AND 19 THEN IF({_luhn(digits)}, 1, 0) ELSE 0 END"}


# --- fitting -------------------------------------------------------------------------------------


class _Texts:
    """Generated texts with one placed thing each: (text, start, end, its kind or none)."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def pick(self, *a):
        return a[self.rng.integers(len(a))]

    def d(self, n: int) -> str:
        return "".join(str(x) for x in self.rng.integers(0, 10, n))

    def chars(self, alphabet: str, n: int) -> str:
        return "".join(alphabet[i] for i in self.rng.integers(0, len(alphabet), n))

    def word(self) -> str:
        return self.chars("abcdefghilmnoprstuvwy", int(self.rng.integers(2, 9)))

    def iban(self) -> str:
        land, body = self.pick("DE", "FR", "ES", "GB", "IT", "NL"), self.d(int(self.rng.integers(14, 20)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        x = f"{land}{check:02d}{body}"
        return x if self.rng.random() < 0.5 else " ".join(x[i : i + 4] for i in range(0, len(x), 4))

    def card(self, good: bool) -> str:
        x = self.pick("4", "5", "37") + self.d(int(self.pick(12, 13, 14)))
        last = next(c for c in "0123456789" if _luhn_of(x + c) == good)
        x += last
        return x if self.rng.random() < 0.6 else " ".join(x[i : i + 4] for i in range(0, len(x), 4))

    def personal(self) -> tuple[str, str, str]:
        """(kind, words before, thing)."""
        p, d = self.pick, self.d
        hexed, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
        return p(
            lambda: ("email", p("email ", "write to ", "mail: ", "", "", "is "), f"{self.word()}.{d(2)}@{self.word()}.{p('com', 'org', 'de')}"),
            lambda: ("ip", p("from ip ", "address ", "host ", "", "", "at "), ".".join(str(x) for x in self.rng.integers(1, 255, 4))),
            lambda: ("card", p("card ", "visa ", "card no ", "", "paid with "), self.card(True)),
            lambda: ("phone", p("phone ", "call ", "tel: ", "", "fax "), f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}"),
            lambda: ("id", p("ssn: ", "ssn ", "social security ", "national id is ", "tax id ", "passport ", "insurance "), f"{self.rng.integers(100, 665)}{p('-', ' ', '-')}{d(1)}{self.rng.integers(1, 10)}-{d(3)}{self.rng.integers(1, 10)}"),
            lambda: ("tel", p("phone ", "call me at ", "tel. ", "fax: ", "mobile: ", "contact ", "ring ", "dial "), p(f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(4)} {d(3)} {d(3)}", f"{d(3)}.{d(3)}.{d(4)}")),
            lambda: ("tel", "", f"({d(3)}) {d(3)}-{d(4)}"),
            lambda: ("iban", p("iban ", "account ", "bank transfer to ", "pay ", "swift: "), self.iban()),
            lambda: ("mail", p("email ", "write to ", "reach me: ", "mail ", "", "contact "), p(f"{self.word()}.{d(2)} (at) {self.word()} (dot) {p('com', 'org')}", f"{self.word()}[at]{self.word()}[dot]{p('org', 'net')}", f"{self.word()} (at) {self.word()} (dot) co (dot) uk")),
            lambda: ("secret", p('token = "', "token: ", 'api_key="', "secret = '", "password: ", "Authorization: Bearer ", "access key ", "passwd=", 'TOKEN = "', "auth_token "), p(self.chars(hexed, int(p(32, 40, 64))), self.chars(hexed, 40).upper(), self.chars(mixed, int(self.rng.integers(18, 60))), "AKIA" + self.chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "ghp_" + self.chars(mixed[:62], 36))),
            lambda: ("account", p("account ", "bank account ", "card ", "acct ", "routing "), p(d(8), d(10), self.card(False), f"{d(4)} {d(4)} {d(4)}")),
        )()

    def other(self) -> tuple[str, str]:
        """Things that look alike and are nobody's."""
        p, d = self.pick, self.d
        hexed = "0123456789abcdef"
        long = lambda: p("-", "_", "")
        return p(
            lambda: (p("version ", "build ", "", "v"), f"{d(1)}.{d(1)}.{d(2)}.{self.rng.integers(256, 9999)}"),
            lambda: (p("isbn ", "isbn: ", "ref ", "order ", "item "), p(f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}")),
            lambda: (p("part no ", "order ", "lot ", "serial ", "model ", "case ", "ticket "), p(f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", d(8), d(10), f"{d(4)}-{d(4)}", f"{p('AB', 'XK', 'QR')}{d(2)}{d(8)}", self.card(False))),
            lambda: (p("", "on ", "since ", "year "), p(f"20{d(2)}-{self.rng.integers(10, 13)}-{self.rng.integers(10, 29)}", f"{self.rng.integers(10, 29)}.{self.rng.integers(10, 13)}.20{d(2)}", f"20{d(2)} 20{d(2)}", f"19{d(2)}-20{d(2)}", f"20{d(2)} 19{d(2)} 20{d(2)}")),
            lambda: (p("score ", "sum ", "total ", "$", "€", "price ", ""), p(f"{d(3)} {d(3)} {d(3)}", f"{d(2)} {d(3)} {d(4)}", f"1 {d(3)} {d(3)}", d(7), d(9), f"{d(3)}.{d(3)}.{d(3)}", f"{d(4)}.{d(3)}.{d(3)}")),
            lambda: (p("page ", "between ", "row ", "the ", "of ", "and ", ""), p(f"{d(3)} {d(3)} {d(4)}", f"{d(4)} {d(4)} {d(4)}", f"{d(2)}/{d(3)}-{d(3)}", f"{d(4)} {d(4)}", d(16), f"{d(3)}-{d(2)}-{d(4)}", f"000-{d(2)}-{d(4)}", f"{d(2)} {d(2)} {d(2)} {d(2)}")),
            lambda: (p("commit ", "sha1 ", "sha256: ", "md5 ", "checksum ", "digest ", "hash "), self.chars(hexed, int(p(32, 40, 64)))),
            lambda: (p("the ", "a ", "see ", "", "in "), p(long().join(self.word() for _ in range(4)) + self.word() + self.word(), "/".join(self.word() for _ in range(5)) + "/usr/share", "supercalifragilistic" + self.word(), "=" * 3 + "-" * 30, "_" * 24, self.word() * 5)),
            lambda: (p("look ", "meet ", "the ", ""), p("look(at)this(dot)", f"{self.word()} (at) noon", f"x{d(1)} (at) noon (dot) dash")),
            lambda: (p("model ", "plate ", "lot ", "", "code "), p(f"{p('GB', 'XK', 'ZZ')}{d(2)} {d(4)} {d(4)}", f"{p('AB', 'SN')}{d(2)}ABCD{d(4)}", f"DE{d(2)}LOREMIPS{d(4)}")),
        )()

    def text(self) -> tuple[str, int, int, str]:
        y = bool(self.rng.random() < 0.5)
        kind, cue, thing = self.personal() if y else ("", *self.other())
        if not y and self.rng.random() < 0.06:  # a word that misleads
            cue = self.pick("call ", "account ", "mail ", "id ") + cue
        head = " ".join(self.word() for _ in range(self.rng.integers(0, 6)))
        start = f"{head} {cue}" if head else cue
        tail = self.pick("", ".", " ", ", ", '"', ")", "!!", "###") + " " + " ".join(self.word() for _ in range(self.rng.integers(0, 5)))
        return start + thing + tail, len(start), len(start) + len(thing), kind


def proposed(text: str) -> list[tuple[str, int, int, list[float]]]:
    """(kind, start, end, features) of all proposals in a text, in Python, for fitting."""
    out = []
    for kind, pattern in {**BASE, **ADDED}.items():
        found = list(re.finditer(pattern.replace(r"\G|", ""), text))
        for k, m in enumerate(found):
            lo, hi = found[k - 1].end() if k else 0, found[k + 1].start() if k + 1 < len(found) else len(text)
            out.append((kind, m.start(), m.end(), features(kind, m[0], text[max(lo, m.start() - BEFORE) : m.start()], text[m.end() : min(hi, m.end() + AFTER)])))
    return out


def _labelled(rng: np.random.Generator, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Proposals of generated texts; positive if they name what the template placed, and cover it."""
    rows, labels, make = [], [], _Texts(rng)
    for _ in range(texts):
        text, lo, hi, placed = make.text()
        for kind, start, end, x in proposed(text):
            rows.append(x)
            labels.append(float(kind == placed and start <= lo + 1 and end >= hi - 1))
    return np.array(rows), np.array(labels)


@cache
def trained(precision: float = 0.97, texts: int = 3_000) -> tuple[Boosted, tuple[float, ...]]:
    """The trees, and each kind's threshold: the lowest logit from which held-out proposals have that precision."""
    model = boost(*_labelled(np.random.default_rng(100), texts), trees=40, depth=4, rate=0.25)
    x, y = _labelled(np.random.default_rng(101), texts)
    z, out = model.logit(x), []
    for k in range(len(KINDS)):
        own = x[:, 0] == k
        order = np.argsort(-z[own], kind="stable")
        score = z[own][order]
        good = np.cumsum(y[own][order]) / np.arange(1, len(score) + 1)
        last = np.append(score[1:] < score[:-1], True)  # only where a tie of scores ends
        passing = np.nonzero((good >= precision) & last)[0] if len(score) else []
        out.append(max(0.0, float(score[passing[-1]]) - 1e-6) if len(passing) else float("inf"))
    return model, tuple(out)


# --- the operator --------------------------------------------------------------------------------


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: tuple = ()) -> DataFrame:
    """(id_col, base, added): arrays of (start, kind, end, hit, score), each in order of start, then kind.

    The score is the trees' logit above the kind's threshold; base spans have theirs too, but are kept
    whatever it is. ``carry`` names further columns of ``df``, or gives expressions, to pass on; they follow,
    after the text if it is kept.
    """
    passed = df.select(*carry).columns
    out = df.select(F.struct(F.col(id_col).alias("id"), *(c.alias(f"c{i}") for i, c in enumerate(F.col(x) if isinstance(x, str) else x for x in carry))).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    patterns = {**BASE, **ADDED}
    out = out.select("id", "t", *(F.expr(f"regexp_extract_all(t, {_literal(p)}, 0)").alias(f"h_{k}") for k, p in patterns.items()))
    out = out.select("id", "t", F.expr("concat(" + ", ".join(_proposals(k, p, "t", f"h_{k}") for k, p in patterns.items()) + ")").alias("p"))
    model, thresholds = trained()
    packed = ", ".join(f"{sql} AS {n}" for n, sql in _feature_sql("s").items())
    high = "array(" + ", ".join("CAST(1e9 AS DOUBLE)" if t == float("inf") else f"{t:.6f}D" for t in thresholds) + ")"
    score = _bound(f"struct({packed})", "f", f"{model.sql([f'f.{n}' for n in FEATURES])} - element_at({high}, s.kind + 1)")
    scored = f"filter(transform(p, s -> struct(s.start AS start, s.kind AS kind, s.end AS end, s.hit AS hit, CAST({score} AS DOUBLE) AS score, s.base AS base)), s -> s.base OR (s.kind >= {len(BASE)} AND s.score >= 0))"
    out = out.select("id", "t", F.expr(f"CASE WHEN size(p) > 0 THEN array_sort({scored}) ELSE CAST(array() AS array<struct<start:int,kind:int,end:int,hit:string,score:double,base:boolean>>) END").alias("q"))
    # spans that touch one another in a row are one group; in it one gives way to an overlapping one with a higher score
    firsts = _bound(_before("transform(q, s -> s.end)", MOST), "m", "filter(sequence(1, size(q)), i -> element_at(q, i).start >= element_at(m, i))")
    groups = _bound(firsts, "w", "transform(sequence(1, size(w)), j -> slice(q, element_at(w, j), IF(j < size(w), element_at(w, least(j + 1, size(w))), size(q) + 1) - element_at(w, j)))")
    better = "(o.base OR o.score > s.score OR (o.score = s.score AND (o.start < s.start OR (o.start = s.start AND o.kind < s.kind))))"
    kept = f"flatten(transform({groups}, c -> IF(size(c) = 1, c, filter(c, s -> s.base OR NOT exists(c, o -> o.start < s.end AND s.start < o.end AND NOT (o.start = s.start AND o.kind = s.kind) AND {better})))))"
    out = out.select("id", "t", F.expr(f"CASE WHEN size(q) > 0 THEN {kept} ELSE q END").alias("q"))
    named = "struct(s.start AS start, s.kind AS kind, s.end AS end, s.hit AS hit, s.score AS score)"
    side = lambda cond, name: F.expr(f"transform(filter(q, s -> {cond}), s -> {named})").alias(name)
    text = [F.col("t").alias(text_col)] if keep_text else []
    return out.select(F.col("id.id").alias(id_col), *text, *(F.col(f"id.c{i}").alias(n) for i, n in enumerate(passed)), side("s.base", "base"), side("NOT s.base", "added"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans in order of start, then kind, joined by commas."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.expr(f"array({names})"), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(df: DataFrame, text: str, spans: str, name: str, block: int = 4096) -> DataFrame:
    """``df`` with the column ``name``: ``text`` with every one of ``spans`` replaced by its kind in brackets.

    Spans that overlap become one, named after the first. The text is cut into blocks once, so that a
    piece is read from its block and not from the text's start.
    """
    names = "array(" + ", ".join(f"'<{k.upper()}>'" for k in KINDS) + ")"
    a, b = "x.a", "(x.b - 1)"
    piece = (
        f"CASE WHEN x.a >= x.b THEN '' WHEN {a} div {block} = {b} div {block} THEN substring(element_at(k, CAST({a} div {block} AS INT) + 1), {a} % {block} + 1, x.b - x.a) "
        f"ELSE concat(substring(element_at(k, CAST({a} div {block} AS INT) + 1), {a} % {block} + 1), array_join(slice(k, CAST({a} div {block} AS INT) + 2, CAST({b} div {block} - {a} div {block} AS INT) - 1), ''), substring(element_at(k, CAST({b} div {block} AS INT) + 1), 1, {b} % {block} + 1)) END"
    )
    cuts = _bound(_before(f"transform(`{spans}`, s -> s.end)", MOST), "m", f"filter(transform(sequence(1, size(`{spans}`)), i -> struct(element_at(m, i) AS a, element_at(`{spans}`, i).start AS b, element_at({names}, element_at(`{spans}`, i).kind + 1) AS mark, i AS i)), x -> x.b >= x.a)")
    last = f"struct(array_max(transform(`{spans}`, s -> s.end)) AS a, length(`{text}`) AS b, '' AS mark, 0 AS i)"
    blocks = f"regexp_extract_all(`{text}`, '(?s).{{1,{block}}}', 0)"
    done = _bound(blocks, "k", f"array_join(transform(array_append({cuts}, {last}), x -> concat({piece}, x.mark)), '')")
    return df.withColumn(name, F.expr(f"CASE WHEN size(`{spans}`) > 0 THEN {done} ELSE `{text}` END"))
