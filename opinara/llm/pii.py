"""Personal data: candidate spans scored by gradient-boosted trees (DataFrame operations only).

High-recall generators propose spans, which may overlap: the four base kinds (email, ip, card, phone; a base match
that passes its own test always stays) and looser ones: phone numbers without a plus or with too few digits, groups of digits
as on cards (in longer digit runs, or failing the check sum), social security numbers, IBANs, spelled-out or spaced e-mail
addresses, dates (of birth, as the context says), names with a title, street addresses. Each loose proposal
gets features of its format and its context (words before it, neighbouring characters). Boosted regression trees on
the log loss score them; scores are calibrated on a held-out part (Platt), and for each kind the least
threshold is taken at which the held-out precision reaches ``precision``. Proposals at or over their threshold that overlap no
base span are added. Of loose spans that overlap one after the other the one of the highest score stays, the earlier one at ties.

The documents have no labels for personal data, so trees are fitted on generated, labelled sentences
(:func:`training_rows`: templates and a seed), whose features come from the same expressions as the
documents'. Fitting runs on the driver on those few thousand rows; scoring is a CASE expression.

Positions are code points, ends exclusive. A null or empty text has no spans. Repeated rows get equal results; no documents
give no rows; columns beyond id and text are ignored. A text costs its length and, where there are proposals, sorts of its spans: positions and overlaps
come from running sums and maxima.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm.common import id_and_text, let

#: Kinds in the order of the results. Runs are matched from their first character on and possessively, so
#: that a long run costs its length and the matcher never recurses; matches are those of the plain patterns
#: in the comments.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this cannot hold the kind.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
LOOSE = {
    "local_phone": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3}\b)?",
    "spelled_email": r"[A-Za-z0-9._%+-]{1,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "spaced_email": r"[A-Za-z0-9._%+-]{1,64}\x20@\x20[A-Za-z0-9-]{1,63}(?:\x20?\.\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "card_groups": r"(?<![0-9])(?:(?:[0-9]{4}[\x20-]?){3}[0-9]{1,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])",
    "short_phone": r"\+[0-9](?:[\x20().-]{0,2}[0-9]){6,7}(?![0-9])",
    "birth_date": r"(?<![0-9])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])",
    "titled_name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sra?)\.?\x20\p{Lu}\p{L}{1,20}(?:\x20\p{Lu}\p{L}{1,20})?",
    "street": r"\b[0-9]{1,5}\x20(?:\p{Lu}\p{L}{1,20}\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive)\b",
}
NEEDS |= {
    "local_phone": r"[0-9]{3}[)\x20.-]",
    "ssn": r"[0-9]-[0-9]{2}-[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "spelled_email": r"[(\[]at[)\]]",
    "spaced_email": r"\x20@\x20",
    "card_groups": r"[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}|[0-9]{4}[\x20-][0-9]{6}",
    "short_phone": r"\+[0-9]",
    "birth_date": r"[0-9][./-][0-9]{1,2}[./-][0-9]",
    "titled_name": r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sra?)\.?\x20",
    "street": r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive)\b",
}
KINDS = [*BASE, *LOOSE]
CUES = {
    "cue_phone": r"(?i)\b(phone|tel|telephone|call|mobile|cell|fax|whatsapp|dial)\b",
    "cue_id": r"(?i)\b(ssn|social|security|taxpayer)\b",
    "cue_bank": r"(?i)\b(iban|account|bank|card|visa|mastercard|credit|payment|transfer)\b",
    "cue_mail": r"(?i)\b(e-?mail|contact|write|reach|mailto)\b",
    "cue_birth": r"(?i)\b(born|birth|birthday|dob|birthdate)\b",
    "cue_place": r"(?i)\b(address|lives|live|home|deliver|at)\b",
    "cue_other": r"(?i)\b(order|invoice|isbn|version|part|serial|item|page|score|ref|model|room|tracking|updated|rate|price)\b",
}
CONTEXT = 32
STRUCT = "array<struct<kind:string,start:int,end:int,value:string>>"
NEAR = "array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>"
#: Running sums are made of the sums of blocks of 2^this many values and of those before within the block.
BLOCK_BITS = 7


def running(values: Column, merge: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each of an array's values what ``merge`` makes of those before it.

    An accumulator that grows with the list would be copied at each step; here none does, and n values cost n * (64 + n / 32768) steps.
    """
    fold = lambda a: F.aggregate(a, F.lit(zero), lambda x, y: merge(x, y).cast("int"))
    size = 1 << BLOCK_BITS

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(v) - 1, BLOCK_BITS)), lambda k: fold(F.slice(v, k * size + 1, F.lit(size))))
        within = lambda i: fold(F.slice(v, i - i.bitwiseAND(F.lit(size - 1)) + 1, i.bitwiseAND(F.lit(size - 1))))
        return let(let(blocks, lambda s: F.transform(s, lambda x, k: fold(F.slice(s, F.lit(1), k)))), lambda o: F.transform(v, lambda x, i: merge(F.get(o, F.shiftright(i, BLOCK_BITS)), within(i)).cast("int")))

    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<int>")))


def _sum(x: Column, y: Column) -> Column:
    return x + y


def matches(text: Column, kind: str, pattern: str, valid: Callable[[Column], Column] = lambda v: F.lit(True), near: bool = False) -> Column:
    """Leftmost non-overlapping matches with positions: what lies between them, summed up, gives the starts. Only ``valid`` ones stay.

    With ``near`` a match has up to 32 characters ``before`` it, back to the match of its kind before, and one ``after``. There is
    one piece more than matches, so the last match is null and adds nothing.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(p: Column) -> Column:
        lengths = F.transform(p, lambda x: (F.length(x["b"]) + F.coalesce(F.length(x["m"]), F.lit(0))).cast("int"))

        def one(x: Column, i: Column, at: Column) -> Column:
            start = (F.get(at, i) + F.length(x["b"])).cast("int")
            fields = [F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["m"])).cast("int").alias("end"), x["m"].alias("value")]
            if near:
                fields += [F.right(x["b"], F.lit(CONTEXT)).alias("before"), F.left(F.coalesce(F.get(p, i + 1)["b"], F.lit("")), F.lit(1)).alias("after")]
            return F.struct(*fields)

        every = let(running(lengths, _sum, 0), lambda at: F.transform(p, lambda x, i: one(x, i, at)))
        return F.filter(every, lambda s: s["value"].isNotNull() & valid(s["value"]))

    return let(F.arrays_zip(found.alias("m"), between.alias("b")), spans)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        bare = lambda x: F.regexp_replace(x, "^0+", "")
        small = lambda x: F.when(F.length(bare(x)) > 3, False).when(bare(x) == "", True).otherwise(bare(x).cast("int") <= 255)
        return F.forall(F.split(v, r"\."), lambda x: F.when(F.length(x) > 0, small(x)).otherwise(False))
    if kind == "card":
        return F.when((n < 13) | (n > 19), False).otherwise(luhn(_digits(v)))
    return (n >= 9) & (n <= 15)


def _base(text: Column, kind: str, pattern: str) -> Column:
    return matches(text, kind, pattern, lambda v: _valid(kind, v))


def base_spans(text: Column) -> Column:
    """Valid base spans by kind as listed, then start."""
    parts = []
    for kind, pattern in BASE.items():
        parts.append(F.when(text.rlike(NEEDS[kind]), _base(text, kind, pattern)).otherwise(F.array().cast(STRUCT)))
    return F.concat(*parts)


def proposals(text: Column) -> Column:
    """Loose spans, overlapping or not."""
    none = F.array().cast(NEAR)
    return F.concat(*[F.when(text.rlike(NEEDS[k]), matches(text, k, p, near=True)).otherwise(none) for k, p in LOOSE.items()])


FEATURES = [*(f"is_{k}" for k in LOOSE), "digits", "length", "signs", "digit_before", "letter_before", "digit_after", "letter_after", "luhn", "capitals", *CUES]


def features(s: Column) -> Column:
    """The features of a proposal as an array of doubles, in the order of FEATURES."""
    v, before, after = s["value"], s["before"], s["after"]
    last = F.right(before, F.lit(1))
    d = _digits(v)
    cols = [
        *[s["kind"] == k for k in LOOSE],
        F.length(d),
        F.length(v),
        F.length(F.regexp_replace(v, "[A-Za-z0-9]", "")),
        last.rlike("[0-9]"),
        last.rlike("[A-Za-z]"),
        after.rlike("[0-9]"),
        after.rlike("[A-Za-z]"),
        F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False),
        F.length(F.regexp_replace(v, "[^A-Z]", "")),
        *[before.rlike(c) for c in CUES.values()],
    ]
    return F.array(*[c.cast("int").cast("double") for c in cols])


# --- trees --------------------------------------------------------------------------------------


def training_rows(n: int = 4000, seed: int = 11) -> list[tuple[str, str, int]]:
    """(text, value, label): generated sentences that hold one value, which is personal or not."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    up = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(3, 9)))
    sep = lambda: rng.choice("-. ")
    name = lambda: word().capitalize()

    def card(valid: bool) -> str:
        d = num(15)
        check = -sum(x if i % 2 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10
        d += str(check if valid else (check + rng.randint(1, 9)) % 10)
        return rng.choice(["", " ", "-"]).join(d[i : i + 4] for i in range(0, 16, 4))

    def date() -> str:
        y, m, d = rng.randint(1930, 2024), rng.randint(1, 12), rng.randint(1, 28)
        return rng.choice([f"{d}.{m}.{y}", f"{m:02}/{d:02}/{y}", f"{y}-{m:02}-{d:02}"])

    make = {
        "phone": lambda: f"({num(3)}) {num(3)}-{num(4)}" if rng.random() < 0.3 else num(3) + (s := sep()) + num(3) + s + num(4),
        "ssn": lambda: f"{num(3)}-{num(2)}-{num(4)}",
        "iban": lambda: up(2) + num(2) + "".join(f" {num(4)}" for _ in range(rng.randint(3, 5))),
        "mail": lambda: f"{word()} [at] {word()} [dot] com" if rng.random() < 0.5 else f"{word()}(at){word()}.org",
        "part": lambda: f"{num(3)}-{num(3)}-{num(4)}",
        "code": lambda: f"{up(2)}{num(2)}{up(4)}{up(4)}{num(4)}",
        "card": lambda: card(rng.random() < 0.5),
        "inner card": lambda: card(True),
        "number": lambda: card(False),
        "short": lambda: f"+{num(2)} {num(2)} {num(4)}" if rng.random() < 0.5 else f"+{num(rng.choice([7, 8]))}",
        "date": date,
        "name": lambda: f"{rng.choice(['Mr', 'Mrs', 'Ms', 'Dr', 'Prof'])}{rng.choice(['', '.'])} {name()}" + rng.choice(["", f" {name()}"]),
        "street": lambda: f"{num(rng.randint(1, 3))} {name()} {rng.choice(['Street', 'Avenue', 'Road', 'Lane'])}",
        "spaced": lambda: f"{word()} @ {word()} . {rng.choice(['com', 'org', 'de'])}",
        "hash": lambda: "".join(rng.choice("0123456789ABCDEF") for _ in range(40)),
        "rated": lambda: f"{word()} @ {num(1)}.{num(2)}",
    }
    yes = [
        ("phone", ["call me at", "phone:", "my mobile is", "tel", "fax"]), ("ssn", ["SSN", "social security number", "ssn:"]), ("iban", ["IBAN", "bank account", "transfer to"]), ("mail", ["write to", "contact", "email:", "reach me:", ""]),
        ("card", ["credit card", "visa", "my card is", "card number:"]), ("inner card", ["", num(9), f"ref {num(10)}"]), ("short", ["call", "phone:", "tel", "mobile"]), ("date", ["born on", "date of birth", "dob:", "birthday:"]),
        ("name", ["contact", "dear", "from", "with", ""]), ("street", ["address:", "lives at", "deliver to", ""]), ("spaced", ["write to", "contact", "email", ""]),
    ]
    no = [
        ("part", ["part", "serial", "order", "item number", "model", ""]), ("ssn", ["invoice", "isbn", "ref", "version", ""]), ("code", ["serial", "model", "room", "ref", ""]), ("phone", ["score", "page", "order", "ref"]),
        ("number", ["order", "tracking", "serial", "ref", ""]), ("short", ["score", "page", "rate", "model"]), ("date", ["updated", "version", "meeting on", "invoice of", "on", ""]), ("rated", ["rate", "price", "score", ""]), ("hash", ["token =", "key", "sum", ""]),
    ]
    rows = []
    for _ in range(n):
        label = rng.random() < 0.5
        kind, cues = rng.choice(yes if label else no)
        value = make[kind]()
        tail = rng.choice([" ", ".", ", ", f" {word()}"])
        glue = rng.choice(["x", num(2)]) if not label and rng.random() < 0.2 else ""
        rows.append((f"{word()} {word()} {rng.choice(cues)} {glue}{value}{tail}{word()}", value, int(label)))
    return rows


class Trees:
    """Boosted trees of depth 3 over the features, with calibration and thresholds by kind."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 50, rate: float = 0.3, precision: float = 0.98):
        held = np.arange(len(y)) % 4 == 3
        p = np.clip(y[~held].mean() if (~held).any() else 0.5, 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(p / (1 - p))), []
        f = np.full(int((~held).sum()), self.start)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-f))
            tree = self._grow(x[~held], y[~held] - q, q * (1 - q), 3)
            self.trees.append(tree)
            f = f + rate * self._value(tree, x[~held])
        self.rate = rate
        raw, yh = self.raw(x[held]), y[held]
        a, b = 1.0, 0.0
        for _ in range(400):  # Platt scaling by gradient steps
            q = 1 / (1 + np.exp(-(a * raw + b)))
            a, b = a - 0.05 * float(((q - yh) * raw).mean()), b - 0.05 * float((q - yh).mean())
        self.a, self.b = a, b
        prob = 1 / (1 + np.exp(-(a * raw + b)))
        self.cut = {}
        for i, kind in enumerate(LOOSE):
            of = x[held][:, i] == 1
            good = [t for t in sorted(set(prob[of])) if t >= 0.5 and yh[of][prob[of] >= t].mean() >= precision]
            self.cut[kind] = float(good[0]) if good else 2.0

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        best, gain = None, 1e-6
        total = g.sum() ** 2 / (h.sum() + 1)
        for j in range(x.shape[1]) if depth else ():
            for t in np.unique(x[:, j])[1:]:
                left = x[:, j] < t
                got = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - total
                if got > gain:
                    best, gain = (j, float(t), left), got
        if best is None:
            return float(g.sum() / (h.sum() + 1))
        j, t, left = best
        return j, t, self._grow(x[left], g[left], h[left], depth - 1), self._grow(x[~left], g[~left], h[~left], depth - 1)

    def _value(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        j, t, low, high = tree
        return np.where(x[:, j] < t, self._value(low, x), self._value(high, x))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((self._value(t, x) for t in self.trees), np.zeros(len(x)))

    def sql(self, name: str) -> str:
        """The calibrated score as an SQL expression over the array ``name``."""

        def case(tree) -> str:
            if isinstance(tree, float):
                return f"{tree!r}D"
            j, t, low, high = tree
            return f"IF({name}[{j}] < {t!r}D, {case(low)}, {case(high)})"

        logit = f"{self.start!r}D + {self.rate!r}D * (" + " + ".join(map(case, self.trees)) + ")"
        return f"1 / (1 + exp(-({self.a!r}D * ({logit}) + {self.b!r}D)))"


def fit_trees(spark: SparkSession, precision: float = 0.98) -> Trees:
    """Fit on the generated sentences; their features are computed by Spark as the documents' are."""
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({i}, {quoted(t)}, {quoted(v)}, {y})" for i, (t, v, y) in enumerate(training_rows()))
    rows = spark.sql(f"SELECT * FROM VALUES {values} AS t(i, text, value, label)")
    got = rows.select("i", "label", "value", "text", F.explode(proposals(F.col("text"))).alias("s"))
    hit = F.instr("text", F.col("value")) - 1
    known = got.select("i", F.when((F.col("s.start") <= hit) & (F.col("s.end") >= hit + F.length("value")), F.col("label")).otherwise(0).alias("y"), features(F.col("s")).alias("x"))
    data = known.orderBy("i", "x").collect()
    return Trees(np.array([r.x for r in data]), np.array([r.y for r in data], float), precision=precision)


def _apart(base: Column, loose: Column) -> Column:
    """The loose spans that overlap no base span, and of those that overlap one after the other the best, by start.

    ``base`` and ``loose`` are arrays of kind, start, end, value and, for loose ones, cut and score.
    """
    # a base span overlaps s if the largest end of those that start before s ends is beyond s' start
    event = lambda at, is_base, end, s: F.struct(at.alias("at"), F.lit(is_base).alias("is_base"), end.alias("end"), s.alias("s"))
    none = F.struct(F.lit("").alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("value"), F.lit(0.0).alias("score"))
    events = F.sort_array(F.concat(F.transform(base, lambda b: event(b["start"], 1, b["end"], none)), F.transform(loose, lambda s: event(s["end"], 0, F.lit(-1), s.dropFields("cut")))))
    reach = lambda e: running(F.transform(e, lambda x: x["end"]), F.greatest, -1)
    outside = let(events, lambda e: let(reach(e), lambda r: F.transform(F.filter(e, lambda x, i: (x["is_base"] == 0) & (F.get(r, i) <= x["s"]["start"])), lambda x: x["s"])))
    by_start = F.sort_array(F.transform(outside, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), s["score"].alias("score"))))

    def numbered(t: Column) -> Column:
        """Each span with the number of its chain."""
        first = let(running(F.transform(t, lambda s: s["end"]), F.greatest, -1), lambda r: F.transform(t, lambda s, i: (s["start"] >= F.get(r, i)).cast("int")))
        chains = let(first, lambda f: let(running(f, _sum, 0), lambda n: F.transform(f, lambda x, i: x + F.get(n, i))))
        return let(chains, lambda c: F.transform(t, lambda s, i: F.struct(F.get(c, i).alias("chain"), (-s["score"]).alias("order"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))

    best = lambda u: F.filter(u, lambda s, i: F.when(i > 0, F.get(u, i - 1)["chain"] != s["chain"]).otherwise(True))
    kept = let(F.sort_array(let(by_start, numbered)), best)
    return F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), (-s["order"]).alias("score")))


def find_pii(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text, base (array of spans) and added (array of spans with score)."""
    own = id_and_text(docs, id_col, text_col)
    found = own.select("doc_id", "text", base_spans(F.col("text")).alias("base"), proposals(F.col("text")).alias("_p"))
    scored = F.transform("_p", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), features(s).alias("x")))
    some = found.select("doc_id", "text", "base", F.when(F.size("_p") > 0, scored).alias("_s"))
    cut = "CASE s.kind " + " ".join(f"WHEN '{k}' THEN {c!r}D" for k, c in trees.cut.items()) + " END"
    passing = F.expr(f"filter(transform(_s, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'value', s.value, 'cut', {cut}, 'score', {trees.sql('s.x')})), s -> s.score >= s.cut)")
    chosen = some.select("doc_id", "text", "base", passing.alias("_c"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:double>>")
    return chosen.select("doc_id", "text", "base", F.when(F.size("_c") > 0, _apart(F.col("base"), F.col("_c"))).otherwise(none).alias("added"))


def redact(found: DataFrame, mark: str = "[{}]") -> DataFrame:
    """The texts of :func:`find_pii` with every span replaced by its kind. Base spans of two kinds may overlap: the first in the text wins."""
    spans = F.array_sort(F.concat(F.transform("base", lambda s: F.struct(s["start"], s["end"], s["kind"])), F.transform("added", lambda s: F.struct(s["start"], s["end"], s["kind"]))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        new = F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit(mark.split("{}")[0]), s["kind"], F.lit(mark.split("{}")[1])))
        later = s["start"] >= a["at"]
        return F.struct(F.when(later, s["end"]).otherwise(a["at"]).alias("at"), F.when(later, new).otherwise(a["out"]).alias("out"))

    return found.select("doc_id", F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text")))).alias("text"))
