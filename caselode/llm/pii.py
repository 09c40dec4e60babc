"""Personal data by candidate gradient boosting (operator 3), in DataFrame and SQL functions only.

Base spans follow four fixed patterns and always stay.  High-recall generators propose overlapping spans over the whole
text: all base-like forms, valid or not, and further ones: e-mail addresses written out or spaced, telephone numbers without
a plus sign, cards with odd separators, IBANs, social security numbers, IPv6 and defanged addresses.  Boosted trees see
each candidate's format and context, and a span is accepted where its probability reaches its kind's threshold.  Thresholds
are calibrated on lines that the trees have not seen, as the least margin at which ``PRECISION`` of the kind's accepted
candidates are true.  Base spans stay whatever the trees say; an added span never overlaps one, and of added ones that
overlap, walking by start, the better stays.

There are no labelled spans to learn from, so the trees learn from ``EXAMPLES`` made-up lines, true and false, of fixed
seed; fitting does not depend on the corpus.  Trees are folded into column expressions.

Sums and choices along a text's matches are made in blocks of a root of their number (``_scan``), so that the
work stays near the text's length however many matches it has.

Positions are code points, ends exclusive.  Defined results: a null text is empty and has no spans; texts of any length are
searched whole; repeated rows are separate; an empty table gives no rows; further columns are passed, but for ``base`` and
``spans``, which are replaced.
"""

from __future__ import annotations

import functools
import random
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import table, written

# The base patterns, by kind, in their listed order.  Quantifiers that nothing can follow are possessive.
BASE = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can hold a valid span of the kind at all.
MAYBE = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9][\x20().0-9-]"}
#: Generators of candidates: kind, pattern, and a cheap test that it can match at all.
GENERATORS = [
    ("email", r"[A-Za-z0-9._%+-]++ ?[\[({<] ?(?i:at|@) ?[\])}>] ?[A-Za-z0-9-]++(?:(?: ?[\[({<] ?(?i:dot|\.) ?[\])}>] ?| (?i:dot) | ?\. ?)[A-Za-z0-9-]{2,}+)++", r"[\[({<] ?(?i:at|@) ?[\])}>]"),
    ("email", r"[A-Za-z0-9._%+-]++ (?i:at) [A-Za-z0-9-]++(?:(?: ?[\[({<] ?(?i:dot) ?[\])}>] ?| (?i:dot) |\.)[A-Za-z0-9-]{2,}+)++", r" (?i:at) [A-Za-z0-9-]++(?: ?[\[({<] ?(?i:dot)| (?i:dot) |\.[A-Za-z0-9])"),
    ("email", r"[A-Za-z0-9._%+-]++(?: @ ?| ?@ |＠)[A-Za-z0-9-]++(?: ?\. ?[A-Za-z0-9-]{2,}+)++", r" @|@ |＠"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})(?![0-9A-Za-z:])", r"::[0-9A-Fa-f]"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?: ?[\[(]\.[\])] ?| \. ?|\. )[0-9]{1,3}(?:(?: ?[\[(]\.[\])] ?| ?\. ?)[0-9]{1,3}){2}(?![0-9.])", r"[0-9] ?[\[(]?\.[\])]? ?[0-9]{1,3} ?[\[(]?\."),
    ("card", r"(?<![0-9])[0-9]{4}(?:[._/\x20-]{1,2}[0-9]{4}){3}(?![0-9])", r"[0-9]{4}[._/\x20-][._/\x20-]?[0-9]{4}"),
    ("card", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    ("card", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9-])", r"[0-9]\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]"),
    ("phone", r"(?<![0-9+])00[1-9][0-9]{0,2}(?:[\x20./-]?[0-9]{2,4}){2,4}(?![0-9])", r"00[1-9]"),
    ("phone", r"(?<![0-9+.-])0[0-9]{1,4}[\x20./-][0-9]{5,8}(?![0-9-])", r"0[0-9]{1,4}[\x20./-][0-9]{5}"),
]
WORDS = {
    "email": r"mail|contact|write|reach|adres|correo|courriel",
    "ip": r"\bip\b|addr|host|server|login",
    "card": r"card|visa|master|iban|konto|account|ssn|social|tarjeta|carte|pay",
    "phone": r"phone|tel|call|mobil|fax|cell|contact|numéro|anruf|llam",
}
NOT = r"version|isbn|order|invoice|date|ref|page|total|part|no\.|id|score|serial|lot"
TLD = r"(?i)[.\x20\])}>](?:com|org|net|edu|gov|info|biz|io|co|uk|de|fr|es|it|nl|eu|us|ca|ch|at|be|pl|se)$"
NAMES = ["digits", "letters", "length", "marks", "luhn", "word", "not_word", "touches", "upper", "groups", "tld", "valid", "zeros", "k_email", "k_ip", "k_card"]
EXAMPLES, TREES, DEPTH, PRECISION = 6000, 20, 4, 0.99
CONTEXT = 28
SPAN = "array<struct<kind:string,start:bigint,stop:bigint,body:string>>"
PROPOSED = "array<struct<kind:string,start:bigint,stop:bigint,body:string,before:string,after:string>>"
#: Stands for a base span's characters while generators search; no pattern matches it.
BLANK = "\u0001"


def _luhn(digits: Column) -> Column:
    """True where the digits pass the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _valid(kind: str, body: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) < 4
        return F.forall(F.split(body, r"\."), lambda p: part(p) & (F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255))
    n = F.length(_digits(body))
    if kind == "card":
        return n.between(12, 19) & _luhn(_digits(body))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def _blocks(items: Column, width=F.sqrt) -> Column:
    """An array that isn't empty, cut into blocks whose width is that root of its length."""

    def cut(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(t["items"]) - 1) / t["width"]).cast("int")), lambda b: F.slice(t["items"], b * t["width"] + 1, t["width"]))

    return _let(items, lambda a: _let(F.struct(a.alias("items"), F.greatest(F.lit(1), F.ceil(width(F.size(a))).cast("int")).alias("width")), cut))


def _scan(items: Column, first: Column, step, state: str) -> Column:
    """The states before each item and, at the end, after the last; ``step`` makes the next state of a state and an item.

    Block by block: a step copies the states of its block only, a block those of the blocks before.
    """
    rows, blocks = F.array().cast(f"array<{state}>"), F.array().cast(f"array<array<{state}>>")

    def one(acc: Column, item: Column) -> Column:
        return F.struct(step(acc["at"], item).cast(state).alias("at"), acc["done"].alias("done"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        begun = F.struct(acc["at"].alias("at"), acc["done"].alias("done"), rows.alias("out"))
        return F.aggregate(part, begun, one, lambda r: F.struct(r["at"].alias("at"), F.concat(r["done"], F.array(r["out"])).alias("done")))

    begun = F.struct(first.cast(state).alias("at"), blocks.alias("done"))
    whole = lambda a: F.aggregate(_blocks(a, F.cbrt), begun, block, lambda r: F.concat(F.flatten(r["done"]), F.array(r["at"])))
    return _let(items, lambda a: F.when(F.size(a) > 0, whole(a)).otherwise(F.array(first.cast(state))))


def _matches(kind: str, pattern: str, text: Column, test: str, shortest: int, context: bool = False) -> Column:
    """All matches with their places: the pieces between matches give the lengths.

    With ``context``, also up to ``CONTEXT`` characters from the match before on, and the character after.
    """
    gaps, bodies = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(t: Column) -> Column:
        lengths = F.zip_with(t["gaps"], t["bodies"], lambda g, b: F.length(g) + F.coalesce(F.length(b), F.lit(0)))
        return _let(F.struct(t["gaps"].alias("gaps"), t["bodies"].alias("bodies"), _scan(lengths, F.lit(0), lambda at, n: at + n, "bigint").alias("at")), spans)

    def spans(t: Column) -> Column:
        def span(body: Column, i: Column) -> Column:
            start = t["at"][i] + F.length(t["gaps"][i])
            fields = [F.lit(kind).alias("kind"), start.cast("bigint").alias("start"), (start + F.length(body)).cast("bigint").alias("stop"), body.alias("body")]
            if context:
                last = F.when(i > 0, F.right(t["bodies"][F.greatest(i - 1, F.lit(0))], F.lit(CONTEXT))).otherwise("")
                fields += [F.right(F.concat(last, t["gaps"][i]), F.lit(CONTEXT)).alias("before"), F.left(F.concat(t["gaps"][i + 1], F.coalesce(F.get(t["bodies"], i + 1), F.lit(""))), F.lit(1)).alias("after")]
            return F.struct(*fields)

        return F.filter(F.transform(t["bodies"], span), lambda s: F.length(s["body"]) >= shortest)

    found = _let(F.struct(gaps.alias("gaps"), bodies.alias("bodies")), placed)
    return F.when(F.rlike(text, F.lit(test)), found).otherwise(F.array().cast(PROPOSED if context else SPAN))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base``: the valid base spans of each kind, by start, then kind as listed."""
    return _fixed(docs, F.coalesce(F.col(text), F.lit("")), "base")


def _fixed(docs: DataFrame, t: Column, name: str) -> DataFrame:
    """Add the valid matches of the base patterns in ``t``."""
    for kind, pattern in BASE.items():
        docs = docs.withColumn(f"_{kind}", _matches(kind, pattern, t, MAYBE[kind], LEAST[kind]))
    valid = lambda kind: F.filter(f"_{kind}", lambda s: _valid(kind, s["body"]))
    kept = [valid(kind) for kind in BASE]
    return docs.withColumn(name, _by_place(F.concat(*kept))).drop(*[f"_{k}" for k in BASE])


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in BASE]), kind)


def _by_place(spans: Column) -> Column:
    """Sort by start, then kind as listed."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _order(s["kind"]).alias("o"), s.alias("s")))
    return F.when(F.size(spans) > 1, F.transform(F.array_sort(keyed), lambda k: k["s"])).otherwise(spans)


def _replaced(text: Column, spans: Column, by) -> Column:
    """``text`` with each of ``spans``, which stand by start, replaced; what overlaps an earlier one goes with it.

    Pieces are cut from their block's part of the text, as a character's place is found by walking to it.
    """

    def pieces(t: Column) -> Column:
        made = F.transform(t["spans"], lambda s, i: F.struct(t["at"][i].alias("at"), F.greatest(s["start"], t["at"][i]).alias("upto"), F.greatest(s["stop"], t["at"][i]).alias("stop"), F.when(s["start"] >= t["at"][i], by(s)).otherwise("").alias("label")))
        return _let(_blocks(made), lambda blocks: F.concat(F.array_join(F.transform(blocks, block), ""), F.substring(text, (F.element_at(t["at"], -1) + 1).cast("int"), F.length(text))))

    def block(part: Column) -> Column:
        first = part[0]["at"]
        here = F.substring(text, (first + 1).cast("int"), (F.element_at(part, -1)["stop"] - first).cast("int"))
        return _let(here, lambda h: F.array_join(F.transform(part, lambda p: F.concat(F.substring(h, (p["at"] - first + 1).cast("int"), (p["upto"] - p["at"]).cast("int")), p["label"])), ""))

    run = F.struct(spans.alias("spans"), _scan(spans, F.lit(0), lambda at, s: F.greatest(at, s["stop"]), "bigint").alias("at"))
    return F.when(F.size(spans) > 0, _let(run, pieces)).otherwise(text)


LEAST = {"email": 4, "ip": 7, "card": 12, "phone": 9}


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``proposed``: what the generators find, overlapping, with the text before and after.

    Base-like forms, valid or not, are proposed over the whole text; further forms, and base-like ones that a base span had
    run into (a telephone number before a card), where no ``base`` span lies, so that none hides them.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    hidden = "base" in docs.columns
    docs = docs.withColumn("_t", _replaced(t, F.col("base"), lambda s: F.repeat(F.lit(BLANK), (s["stop"] - s["start"]).cast("int"))) if hidden else t)
    found = [(kind, pattern, t, MAYBE[kind], LEAST[kind]) for kind, pattern in BASE.items()]
    found += [(kind, pattern, F.when(F.size("base") > 0, F.col("_t")).otherwise(""), MAYBE[kind], LEAST[kind]) for kind, pattern in BASE.items()] if hidden else []
    found += [(kind, pattern, F.col("_t"), hint, 5) for kind, pattern, hint in GENERATORS]
    for i, one in enumerate(found):
        docs = docs.withColumn(f"_g{i}", _matches(*one, context=True))
    every = F.concat(*[F.col(f"_g{i}") for i in range(len(found))])
    run_into = sum((F.size(f"_g{i}") for i in range(len(BASE), 2 * len(BASE))), F.lit(0)) if hidden else F.lit(0)
    return docs.withColumn("proposed", every).withColumn("_run_into", run_into).drop("_t", *[f"_g{i}" for i in range(len(found))])


def features(s: Column) -> dict[str, Column]:
    """Format and context of one candidate as numbers."""
    body, kind = s["body"], s["kind"]
    count = lambda pattern: F.regexp_count(body, F.lit(pattern))
    yes = lambda c: F.when(c, 1).otherwise(0)
    near = F.lower(s["before"])
    word = F.lit(False)
    for k, pattern in WORDS.items():
        word = word | ((kind == k) & F.rlike(near, F.lit(pattern)))
    made = {
        "digits": F.length(_digits(body)),
        "letters": count("[A-Za-z]"),
        "length": F.length(body),
        "marks": count("[^A-Za-z0-9 ]"),
        "luhn": yes((F.length(_digits(body)) >= 12) & _luhn(_digits(body))),
        "word": yes(word),
        "not_word": yes(F.rlike(near, F.lit(NOT))),
        "touches": yes(F.rlike(F.concat(F.right(s["before"], F.lit(1)), F.lit("|"), s["after"]), F.lit("[A-Za-z0-9@#$%=_-]"))),
        "upper": count("[A-Z]"),
        "groups": count("[0-9A-Za-z]+"),
        "tld": yes(F.rlike(body, F.lit(TLD))),
        "valid": functools.reduce(lambda a, k: F.when(kind == k, yes(F.rlike(body, F.lit(f"^{BASE[k]}$")) & _valid(k, body))).otherwise(a), BASE, F.lit(0)),
        "zeros": count("(?<![0-9A-Za-z])0+(?![0-9A-Za-z])|::"),
        "k_email": yes(kind == "email"),
        "k_ip": yes(kind == "ip"),
        "k_card": yes(kind == "card"),
    }
    return {n: made[n].cast("double") for n in NAMES}


def examples(count: int = EXAMPLES, seed: int = 11) -> list[tuple[str, int]]:
    """Made-up lines with one candidate each, and whether it is personal."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 8)))

    def card() -> str:
        body = "4" + d(14)
        total = sum((int(c) * 2 % 10 + int(c) // 5) if i % 2 == 0 else int(c) for i, c in enumerate(body[::-1]))
        return body + str(-total % 10)

    four = lambda s, sep: sep.join(s[i : i + 4] for i in range(0, 16, 4))
    group = lambda: r.choice([f"{r.randrange(65536):x}", f"{r.randrange(65536):x}", f"{r.randrange(256):x}", "0"])
    hexes = lambda n: ":".join(group() for _ in range(n))
    tld = lambda: r.choice(["com", "org", "net", "de", "co.uk", "fr", "io", "edu"])
    name = lambda: r.choice([w(), f"{w()}.{w()}", f"{w()}_{d(2)}", f"{w()}{d(2)}"])
    octet = lambda: str(r.randrange(256))
    seen = lambda *words: r.choice([*words, w(), f"{w()} {w()}"])
    at = lambda: r.choice([" [at] ", "(at)", " (at) ", "[at]", " {at} ", " <at> ", " AT ", " at "])
    dot = lambda: r.choice([" dot ", " [dot] ", ".", "[.]", " (dot) ", " DOT "])
    local = lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(3)} {d(4)}", f"0{d(3)}/{d(6)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)}-{d(7)}"])
    bad = lambda: four((c := card())[:-1] + str((int(c[-1]) + r.randint(1, 9)) % 10), r.choice([".", "  ", "_", "/", "-", " ", ""]))
    true = [
        lambda: f"{seen('mail me', 'contact', 'e-mail', 'write to', 'reach')} {name()}{at()}{w()}{dot()}{tld()}",
        lambda: f"{seen('mail', 'contact')} {name()}{r.choice([' @ ', ' @', '@ ', '＠'])}{w()}{r.choice(['.', ' . '])}{tld()}",
        lambda: f"{seen('mail', 'contact')} {name()}@{w()}.{tld()}",
        lambda: f"{seen('call', 'phone', 'tel.', 'mobile', 'fax')} +{d(2)} {d(3)} {d(3)} {d(4)}",
        lambda: f"{r.choice(['call', 'phone', 'tel.', 'tel:', 'mobile', 'fax', 'cell', 'telephone', 'ring', 'text me on', 'my number is'])} {local()}",
        lambda: f"{seen('call', 'phone', 'tel.')} 00{r.choice(['44', '49', '1', '33'])} {d(3)} {d(3)} {d(4)}",
        lambda: f"{seen('card', 'visa', 'pay with', 'charged to')} {four(card(), r.choice(['.', '  ', '_', '/', '-', ' ', '']))}",
        lambda: f"{seen('iban', 'account', 'konto', 'transfer to')} {r.choice(['DE', 'GB', 'FR', 'NL', 'ES'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}",
        lambda: f"{r.choice(['ssn', 'social security', 'ssn is', 'social security number:', 'ssn:'])} {d(3)}-{d(2)}-{d(4)}",
        lambda: f"{seen('ip', 'host', 'login from', 'server addr', 'connected to', 'ip:')} {hexes(8)}",
        lambda: f"{seen('ip', 'host', 'login from', 'ping')} {hexes(r.randint(1, 4))}::{hexes(r.randint(1, 4))}",
        lambda: f"{seen('ip', 'host', 'login from')} {'.'.join(octet() for _ in range(4))}",
        lambda: f"{seen('ip', 'host', 'login from')} {r.choice(['[.]', '(.)', ' . ']).join(octet() for _ in range(4))}",
    ]
    false = [
        lambda: f"{w()} {w()} at {w()}.{w()}x",
        lambda: f"{w()} was at {w()}.{w()}q {w()}",
        lambda: f"{w()} at {r.choice(['home', 'noon', w()])} dot {w()}q",
        lambda: f"{w()} @ {w()}{r.choice(['.', ' . '])}{w()}q",
        lambda: f"{seen('date', 'page', 'ref', 'order', 'invoice')} {d(4)} {d(3)} {d(4)}",
        lambda: f"{seen('isbn', 'part', 'serial', 'order')} {d(3)}-{d(3)}-{d(4)}",
        lambda: f"{seen('total', 'score', 'sum')} {d(2)} {d(3)} {d(3)}",
        lambda: f"{seen('order', 'lot', 'ref', 'serial')} {bad()}",
        lambda: f"{seen('ref', 'serial')} AB{d(2)} {d(4)} {d(4)} {d(4)}",
        lambda: f"{seen('id', 'lot', 'part')} {d(3)}-{d(2)}-{d(4)}",
        lambda: f"{seen('version', 'time', 'build')} {hexes(r.randint(4, 6))}",
        lambda: f"{w()} {d(2)}:{d(2)}:{d(2)}:{d(2)}",
        lambda: f"{r.choice(['std', w()])}::{w()}",
        lambda: f"{w()} +{d(2)} {d(2)} {d(3)}",
        lambda: f"{seen('version', 'release', 'section')} {octet()}.{octet()}.{octet()}.{r.randint(256, 999)}",
        lambda: f"{seen('version', 'scores')} {r.choice([' . ', '. ']).join(str(r.randint(256, 999)) for _ in range(4))}",
        lambda: f"{seen('order', 'lot')} 00{d(10)}",
        lambda: f"{seen('order', 'part', 'ref')} 0{d(2)}-{d(7)}",
    ]
    return [(f"{w()} {w()} {r.choice(true if i % 2 else false)()} {w()}", i % 2) for i in range(count)]


_fitted: dict[str, tuple[list, dict[str, float]]] = {}


def _tree(text: str):
    """A tree's printed form as nested (feature, edge, left, right)."""
    lines = [x for x in (line.strip() for line in text.strip().splitlines()) if x]

    def node():
        line = lines.pop(0)
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        feature, edge = re.match(r"If \(feature (\d+) <= (-?[\d.eE+-]+)\)", line).groups()
        left = node()
        lines.pop(0)
        return int(feature), float(edge), left, node()

    return node()


def _evaluated(node, x: dict[str, Column]) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, edge, left, right = node
    return F.when(x[NAMES[feature]] <= edge, _evaluated(left, x)).otherwise(_evaluated(right, x))


def threshold(rows: list[tuple[float, float]], precision: float = PRECISION) -> float | None:
    """The least margin at which ``precision`` of the (margin, label) rows at or above it are true; None where there is none."""
    rows = sorted(rows, reverse=True)
    true, least = 0.0, None
    for i, (m, label) in enumerate(rows, 1):
        true += label
        if true / i >= precision and (i == len(rows) or rows[i][0] < m):
            least = m
    return least


def examples_table(spark: SparkSession, count: int = EXAMPLES, seed: int = 11) -> DataFrame:
    """(text, label, held) of the made-up lines.  Which lines are held out goes by a hash of the text, apart from the label."""
    parts = ", ".join(f"('{text}', {label})" for text, label in examples(count, seed))
    return spark.sql(f"select text, label, pmod(xxhash64(text), 4) = 0 held from values {parts} as t(text, label)").coalesce(1)


def fitted(spark: SparkSession) -> tuple[list, dict[str, float]]:
    """Trees with weights, and each kind's calibrated margin; fitted once per application."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    app = spark.sparkContext.applicationId
    if app in _fitted:
        return _fitted[app]
    # Written, so that features are worked out from a column and not from the generators' expressions again.
    seen = written(candidates(examples_table(spark)).select("held", "label", "proposed"), "span-examples").select("held", "label", F.explode("proposed").alias("s"))
    x = seen.select("held", "s.kind", "label", *[c.alias(n) for n, c in features(F.col("s")).items()])
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(x).select("held", "kind", F.col("label").cast("double").alias("label"), "features", *NAMES)
    learn, held = vectors.filter("not held").cache(), vectors.filter("held").cache()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5).fit(learn)
    trees = [(_tree(t.toDebugString.split("\n", 1)[1]), w) for t, w in zip(model.trees, model.treeWeights, strict=True)]
    got = held.select("kind", margin(trees, {n: F.col(n) for n in NAMES}).alias("m"), "label").collect()  # of the fixed examples
    learn.unpersist()
    held.unpersist()
    least = {}
    for kind in sorted({k for k, _, _ in GENERATORS}):
        rows = [(r.m, r.label) for r in got if r.kind == kind]
        if {label for _, label in rows} != {0.0, 1.0} or (m := threshold(rows)) is None:
            raise ValueError(f"no threshold for {kind}: {len(rows)} held lines")
        least[kind] = m
    _fitted[app] = trees, least
    return _fitted[app]


def margin(trees: list, x: dict[str, Column]) -> Column:
    return sum((_evaluated(t, x) * w for t, w in trees), F.lit(0.0))


#: Margin of base spans, past any that trees give.
BASE_MARGIN = 1e9
SCORED = "struct<m:double,kind:string,start:bigint,stop:bigint,body:string>"


def _chosen(spans: Column) -> Column:
    """Of spans that stand by start, those left where of two that overlap the better (then the earlier) stays.

    Base spans, of margin ``BASE_MARGIN``, are the best; such that overlap hold their places together."""

    def step(now: Column, s: Column) -> Column:
        meets = now.isNotNull() & (s["start"] < now["stop"])
        both = meets & (s["m"] == BASE_MARGIN) & (now["m"] == BASE_MARGIN)
        joint = F.struct(now["m"].alias("m"), now["kind"].alias("kind"), now["start"].alias("start"), F.greatest(now["stop"], s["stop"]).alias("stop"), now["body"].alias("body"))
        return F.when(both, joint).when(meets & (s["m"] <= now["m"]), now).otherwise(s)

    def last(t: Column) -> Column:
        # The state after item i stays if the next item doesn't overlap it: it can't be replaced any more.
        final = lambda s, i: (i == F.size(t["spans"]) - 1) | (F.get(t["spans"], i + 1)["start"] >= s["stop"])
        return F.filter(F.slice(t["states"], F.lit(2), F.size(t["spans"])), final)

    states = _scan(spans, F.lit(None), step, SCORED)
    return _let(F.struct(spans.alias("spans"), states.alias("states")), last)


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base`` and ``spans`` (base and added), arrays of (kind, start, stop, body)."""
    trees, least = fitted(docs.sparkSession)
    found = candidates(base_spans(docs, text), text)
    scored = F.transform("proposed", lambda s: F.struct(margin(trees, features(s)).alias("m"), s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["body"].alias("body")))
    enough = lambda s: functools.reduce(lambda a, b: a | b, [(s["kind"] == k) & (s["m"] >= m) for k, m in least.items()])
    found = found.withColumn("_accepted", F.filter(scored, enough)).drop("proposed")
    sure = F.transform("base", lambda s: F.struct(F.lit(BASE_MARGIN).alias("m"), s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["body"].alias("body")))
    by_start = F.array_sort(F.transform(F.concat(sure, "_accepted"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s.alias("s"))))
    added = lambda spans: F.filter(_chosen(spans), lambda s: s["m"] != BASE_MARGIN)
    best = _let(F.transform(by_start, lambda k: k["s"]), lambda spans: F.transform(added(spans), lambda s: s.dropFields("m")).cast(SPAN))
    # Accepted base-like candidates are mostly base spans themselves; only where there are others is there a choice.
    others = (F.col("_run_into") > 0) | F.exists("_accepted", lambda s: ~_is_base(s))
    some = found.withColumn("_added", F.when(others, best).otherwise(F.array().cast(SPAN)))
    return some.withColumn("spans", F.when(F.size("_added") > 0, _by_place(F.concat("base", "_added"))).otherwise(F.col("base"))).drop("_accepted", "_added", "_run_into")


def _is_base(s: Column) -> Column:
    """Whether a candidate is a valid match of its kind's base pattern."""
    return functools.reduce(lambda a, k: a | ((s["kind"] == k) & F.rlike(s["body"], F.lit(f"^{BASE[k]}$")) & _valid(k, s["body"])), BASE, F.lit(False))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _cleared(text: Column, more: Column, by) -> Column:
    """``text``, where ``more``, with its valid base spans replaced until none is left.

    What is replaced ends a run of digits early, so that a form that ran into it becomes valid.  Labels are in no base span and the
    shortest one has four characters, which bounds the rounds.
    """
    state = "struct<text:string,more:boolean>"

    def found(t: Column) -> Column:
        valid = lambda kind: F.filter(_matches(kind, BASE[kind], t, MAYBE[kind], LEAST[kind]), lambda s: _valid(kind, s["body"]))
        return _by_place(F.concat(*[valid(kind) for kind in BASE]))

    def step(now: Column, _: Column) -> Column:
        after = _let(found(now["text"]), lambda spans: F.struct(_replaced(now["text"], spans, by).alias("text"), (F.size(spans) > 0).alias("more")).cast(state))
        return F.when(now["more"], after).otherwise(now)

    rounds = lambda t: F.sequence(F.lit(0), F.when(t["more"], F.floor(F.length(t["text"]) / 4).cast("int")).otherwise(0))
    return _let(F.struct(text.alias("text"), more.alias("more")).cast(state), lambda t: F.aggregate(rounds(t), t, step, lambda t: t["text"]))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; overlapping spans are replaced as one.

    Base spans that are valid only once others are replaced are replaced too, so that none is left.
    """
    label = lambda s: F.concat(F.lit("["), s["kind"], F.lit("]"))
    inner = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    new = find_spans(inner, "_text").withColumn("_text", _cleared(_replaced(F.col("_text"), F.col("spans"), label), F.size("spans") > 0, label))
    return new.select(*[F.col("_text").alias(text) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[number(k) for k in BASE], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
