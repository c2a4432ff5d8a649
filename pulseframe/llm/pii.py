"""Personal data: base patterns, and wider candidates judged by boosted trees, in SQL functions only.

High-recall generators propose spans that the base patterns miss (spelt-out e-mail addresses, national
telephone numbers, defanged addresses, cards in other groupings). Gradient-boosted trees, fitted by
Spark on a generated training table, judge each by its format and context; a threshold for each kind,
set on held-out generated rows, selects. The trees are applied as SQL expressions within each row, so
the operator is one map over the documents, without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held

KINDS = ("email", "ip", "card", "phone")
#: Base patterns, anchored at the only places where a leftmost match can begin and possessive, so that
#: long runs cost one pass; they match what the plain patterns match (cards: of 13 digits at least).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
AT = r" ?(?:[\[({<] ?(?i:at|@) ?[\])}>]| (?i:at|@) ) ?"
DOT = r"(?: ?[\[({<] ?(?i:dot|\.) ?[\])}>] ?| (?i:dot) | \. |\.)"
WIDE = {
    "email": rf"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]{{1,64}}+{AT}[A-Za-z0-9-]{{1,63}}+(?:{DOT}[A-Za-z0-9-]{{2,63}}+){{1,5}}+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?: ?[\[({] ?\. ?[\])}] ?[0-9]{1,3}+| ?\. ?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4}){2}[ ._/-]{1,2}[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3,4}[ ./-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
}
#: A cheap test that a text can hold a wide candidate at all.
GATE = {"email": r"(?i)[\[({<] ?(?:at|@)|(?: at | @ ).{1,64}(?:dot|\.)", "ip": r"[0-9] ?[\[({.]", "card": r"[0-9]{4}[ ._/-]", "phone": r"[0-9][).]?[ ./-][0-9]"}
#: Context words before a candidate, a feature for each kind.
CUES = {"email": r"(?i)mail|contact|write|reach", "ip": r"(?i)\bip\b|host|server|address|ping", "card": r"(?i)card|visa|master|amex|credit|pay", "phone": r"(?i)phone|tel|call|fax|mobile|cell|whatsapp"}
AGAINST = r"(?i)version|\bv\.?$|isbn|section|chapter|order|invoice|date|page|ratio|part"
FEATURES = ("kind", "digits", "letters", "seps", "brackets", "length", "cue", "against", "valid", "boundary", "tld", "same_seps")
WINDOW = 24
TRAIN_ROWS = 4_000


#: Matches that one inner fold of ``located`` appends: a text of n costs n * BLOCK, not n squared.
BLOCK = 64
MATCH = "struct<s:int,e:int,m:string,before:string,after:string>"


def located(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m, before, after>>: all leftmost matches with their places in code points, and the
    WINDOW code points before and the one after, as far as they reach between matches.

    Matches and the pieces between them alternate, so places are sums of their lengths: first of blocks of
    matches, then within each block."""
    none = F.expr(f"cast(array() as array<{MATCH}>)")
    m, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def piece(x: Column, y: Column) -> Column:
        b, after = y["b"], y["after"]
        return F.struct(x.alias("m"), F.char_length(b).alias("gap"), F.char_length(x).alias("n"), F.right(b, F.lit(WINDOW)).alias("before"), F.left(after, F.lit(1)).alias("after"))

    def around(pieces: Column) -> Column:
        """Each piece with the next one; of the last piece there is none."""
        return F.zip_with(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.slice(pieces, F.lit(2), F.size(pieces) - 1), lambda b, after: F.struct(b.alias("b"), after.alias("after")))

    def start(acc: Column, block: Column) -> Column:
        """Where each block begins, one after another, and where the last ends."""
        size = F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + x["n"])
        return F.concat(acc, F.array(F.element_at(acc, -1) + size))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        found = F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct((s + x["n"]).alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    def placed(block: Column, begins: Column) -> Column:
        return F.aggregate(block, F.struct(begins.alias("at"), none.alias("out")), step, lambda a: a["out"])

    def split_up(pieces: Column) -> Column:
        last = F.ceil(F.size(pieces) / BLOCK).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(pieces, k * BLOCK + 1, F.lit(BLOCK)))

    # A transform over one element names a value once, so that it isn't computed in each place of use.
    def named(value: Column, use) -> Column:
        return F.transform(F.array(value), use)[0]

    def whole(blocks: Column) -> Column:
        begins = F.aggregate(blocks, F.array(F.lit(0)), start)
        return named(begins, lambda at: F.flatten(F.transform(blocks, lambda block, i: placed(block, F.get(at, i)))))

    found = named(F.zip_with(m, named(between, around), piece), lambda pieces: named(split_up(pieces), whole))
    return F.when(text.rlike(pattern), found).otherwise(none)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    n = F.char_length(d)

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = x * 2 - F.when(x > 4, 9).otherwise(0)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _octets(m: Column) -> Column:
    """Each of the four numbers at most 255."""
    return F.forall(F.split(m, r"[^0-9]+"), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("long") <= 255, F.lit(False)))


def _valid(kind: str, m: Column) -> Column:
    n = F.char_length(digits(m))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(m))).otherwise(False)
    return n.between(9, 15)


def base_spans(text: Column, kind: str) -> Column:
    return F.transform(F.filter(located(text, BASE[kind]), lambda x: _valid(kind, x["m"])), lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def _count(m: Column, pattern: str) -> Column:
    return F.char_length(m) - F.char_length(F.regexp_replace(m, pattern, ""))


def candidates(text: Column) -> Column:
    """array<struct<k, s, e, x>>: spans of all generators with their features x."""

    def judged_as(kind: str):
        k = KINDS.index(kind)

        def judged(c: Column) -> Column:
            m, before, after = c["m"], c["before"], c["after"]
            seps = F.regexp_replace(m, r"[0-9A-Za-z]", "")
            valid = luhn(digits(m)) & F.char_length(digits(m)).between(13, 19) if kind == "card" else _octets(m) if kind == "ip" else F.char_length(digits(m)).between(9, 15) if kind == "phone" else m.rlike(r"(?i)[\[({<] ?(?:at|@)|(?: at | @ ).*(?:dot|\.)")
            x = {
                "kind": F.lit(k), "digits": F.char_length(digits(m)), "letters": _count(m, "[A-Za-z]"), "seps": F.char_length(seps), "brackets": _count(m, r"[\[\](){}<>]"),
                "length": F.char_length(m), "cue": before.rlike(CUES[kind]).cast("int"), "against": before.rlike(AGAINST).cast("int"), "valid": valid.cast("int"),
                "boundary": (~(F.right(before, F.lit(1)).rlike(r"[\p{L}0-9_]") | after.rlike(r"[\p{L}0-9_]"))).cast("int"),
                "tld": m.rlike(r"(?i)[^a-z](?:com|org|net|edu|gov|io|de|fr|es|uk|info)$").cast("int"), "same_seps": (F.char_length(F.replace(seps, F.left(seps, F.lit(1)), F.lit(""))) == 0).cast("int"),
            }
            return F.struct(F.lit(k).alias("k"), c["s"].alias("s"), c["e"].alias("e"), F.array(*[x[n].cast("double") for n in FEATURES]).alias("x"))

        return judged

    found = []
    for kind in KINDS:
        wide = F.when(text.rlike(GATE[kind]), located(text, WIDE[kind])).otherwise(F.expr(f"cast(array() as array<{MATCH}>)"))
        found.append(F.transform(wide, judged_as(kind)))
    return F.concat(*found)


def _training(spark: SparkSession) -> DataFrame:
    """(id, text, kind, label, unseen): generated rows, each with one candidate in a sentence. A row's words
    and numbers come from a hash of its number, so the table is the same everywhere. unseen: the form is
    one of those, a third of each list, that only the thresholds are set on."""
    h = lambda salt, mod: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(mod))
    num = lambda salt, n: F.lpad(h(salt, 10**n).cast("string"), n, "0")
    pick = lambda salt, xs: F.element_at(F.array(*map(F.lit, xs)), (h(salt, len(xs)) + 1).cast("int"))
    name, host = pick(1, ["jan.roe", "mary", "k.lee42", "info", "sales_team", "bob77"]), pick(2, ["example", "mailbox", "corp-one", "uni", "shop24"])
    tld = pick(3, ["com", "org", "net", "de", "fr", "es"])
    octet = lambda salt: h(salt, 256).cast("string")
    d15 = F.concat(pick(4, ["4", "5"]), num(5, 14))
    check = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, F.substring(d15, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(d15, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)).otherwise(F.substring(d15, i, F.lit(1)).cast("int")))
    card = F.concat(d15, ((10 - check % 10) % 10).cast("string"))
    bad = F.concat(d15, ((11 - check % 10) % 10).cast("string"))
    four = lambda c, sep: F.concat_ws(sep, *[F.substring(c, i, 4) for i in (1, 5, 9, 13)])
    yes = {
        "email": [F.concat(name, F.lit(a), host, F.lit(b), tld) for a, b in ((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", "(dot)"), (" @ ", "."), ("[@]", "[.]"), (" AT ", " DOT "), ("{at}", "{dot}"), (" <at> ", "."), ("[at]", "[dot]"))],
        "ip": [F.concat(octet(11), F.lit(a), octet(12), F.lit(a), octet(13), F.lit(a), octet(14)) for a in ("[.]", "(.)", " . ", "{.}", " [.] ", " .")],
        "card": [four(card, sep) for sep in (". ", "/", "_", ".", "--", "- ", " / ")],
        "phone": [F.concat(*x) for x in (
            (F.lit("("), num(21, 3), F.lit(") "), num(22, 3), F.lit("-"), num(23, 4)), (num(21, 3), F.lit("-"), num(22, 3), F.lit("-"), num(23, 4)), (num(21, 3), F.lit("."), num(22, 3), F.lit("."), num(23, 4)),
            (F.lit("0049 "), num(21, 3), F.lit(" "), num(22, 4), F.lit("-"), num(23, 3)), (num(21, 3), F.lit(" "), num(22, 3), F.lit(" "), num(23, 4)), (F.lit("("), num(21, 3), F.lit(")"), num(22, 3), F.lit("."), num(23, 4)),
        )],
    }
    no = {
        "email": [F.concat(*x) for x in (
            (F.lit("look at "), host, F.lit(". "), name), (F.lit("was at "), host, F.lit(" . The")), (F.lit("sold at "), num(35, 2), F.lit("."), num(36, 2)), (F.lit("met at "), host, F.lit(". And")), (F.lit("rated at "), num(35, 1), F.lit("."), num(36, 3)),
        )],
        "ip": [F.concat(*x) for x in (
            (num(31, 3), F.lit(". "), num(32, 3), F.lit(". "), num(33, 3), F.lit(". "), num(34, 3)), (F.lit("1. "), h(35, 99).cast("string"), F.lit(". "), h(36, 9).cast("string"), F.lit(" . 4")),
            (num(31, 3), F.lit(" . "), num(32, 3), F.lit(" . "), num(33, 3), F.lit(" . "), num(34, 3)), (F.lit("2 . "), num(35, 2), F.lit(". "), num(36, 3), F.lit(". 7")),
        )],
        "card": [four(bad, "/"), four(bad, "."), four(bad, "_"), F.concat(num(41, 4), F.lit("/"), num(42, 4), F.lit("/"), num(43, 4), F.lit("/"), num(44, 2)), four(bad, "--"), F.concat(num(41, 4), F.lit("-"), num(42, 4), F.lit("-"), num(43, 4), F.lit("-"), num(44, 1))],
        "phone": [F.concat(*x) for x in (
            (num(51, 3), F.lit("/"), num(52, 3), F.lit("."), num(53, 3)), (F.lit("("), num(51, 4), F.lit(") "), num(52, 3), F.lit(" "), num(53, 3)), (num(51, 4), F.lit(" "), num(52, 4), F.lit(" "), num(53, 3)), (num(51, 4), F.lit("-"), num(52, 4), F.lit("-"), num(53, 4)),
        )],
    }
    good_cue = {"email": ["mail ", "contact me: ", "write to ", ""], "ip": ["host ", "server at ", "ip ", ""], "card": ["card ", "visa: ", "pay with ", ""], "phone": ["call ", "tel. ", "phone: ", ""]}
    bad_cue = ["see section ", "version ", "order ", "the ", "page ", "invoice no. ", "and "]
    parts = []
    for kind in KINDS:
        for label, forms, cues in ((1, yes[kind], good_cue[kind]), (0, no[kind], bad_cue)):
            rows = spark.range(TRAIN_ROWS // (2 * len(KINDS)), numPartitions=1)
            at = h(61, len(forms))
            form = reduce(lambda acc, p: F.when(at == p[0], p[1]).otherwise(acc), enumerate(forms), forms[0])
            text = F.concat(pick(62, ["Then they said ", "Note: ", "In the morning ", "La "]), pick(63, cues), form, pick(64, [" and so on", " for it", ", or later", " ."]))
            parts.append(rows.select("id", text.alias("text"), F.lit(KINDS.index(kind)).alias("kind"), F.lit(label).alias("label"), (at >= len(forms) - len(forms) // 3).alias("unseen")))
    return reduce(DataFrame.unionByName, parts)


class Judge:
    """Fitted trees as SQL, and a threshold of the probability for each kind."""

    def __init__(self, trees: list, weights: list[float], least: dict[int, float]):
        self.trees, self.weights, self.least = trees, weights, least

    def probability(self, x: Column) -> Column:
        margin = F.lit(0.0)
        for t, w in zip(self.trees, self.weights, strict=True):
            margin = margin + _tree(t, x) * w
        return 1 / (1 + F.exp(-2 * margin))

    def taken(self, found: Column) -> Column:
        """array<struct<k, s, e, d>> of the candidates that are personal data, d a digit of 1 to 9 by their
        probability."""
        least = F.array(*[F.lit(float(self.least[k])) for k in range(len(KINDS))])
        scored = F.transform(found, lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"), self.probability(c["x"]).alias("p")))
        sure = F.filter(scored, lambda c: c["p"] >= F.element_at(least, c["k"] + 1))
        return F.transform(sure, lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"), F.least(F.floor(c["p"] * 9) + 1, F.lit(9)).cast("string").alias("d")))


def _tree(node, x: Column) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    at, threshold, left, right = node
    return F.when(F.get(x, F.lit(at)) <= threshold, _tree(left, x)).otherwise(_tree(right, x))


def _read(node):
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    return node.split().featureIndex(), float(node.split().threshold()), _read(node.leftChild()), _read(node.rightChild())


_JUDGES: dict[str, Judge] = {}


def judge(spark: SparkSession, precision: float = 0.97) -> Judge:
    """Fitted once for each application, on TRAIN_ROWS generated rows. A kind's threshold is the lowest, 0.5 at
    least, at which ``precision`` of the candidates above it are personal data, among forms that the trees
    have not seen, halfway to the next candidate below; a kind that never gets there takes none."""
    app = spark.sparkContext.applicationId
    if app in _JUDGES:
        return _JUDGES[app]
    rows = held(_training(spark).coalesce(2)).select("id", "kind", "label", "unseen", F.explode(candidates(F.col("text"))).alias("c")).where("c.k = kind")
    names = [f"x{i}" for i in range(len(FEATURES))]
    data = held(rows.select("id", "kind", "unseen", F.col("label").cast("double").alias("label"), *[F.col("c.x")[i].alias(n) for i, n in enumerate(names)]).coalesce(2))
    data = VectorAssembler(inputCols=names, outputCol="features").transform(data)
    model = GBTClassifier(maxIter=10, maxDepth=4, stepSize=0.3, minInstancesPerNode=3, seed=3).fit(data.where("not unseen"))
    cal = model.transform(data.where("unseen")).select("kind", "label", vector_to_array("probability")[1].alias("p")).collect()
    least = {}
    for k in range(len(KINDS)):
        mine = sorted(((r["p"], r["label"]) for r in cal if r["kind"] == k), reverse=True)
        least[k], hit = 2.0, 0.0
        for n, (p, y) in enumerate(mine, 1):
            hit += y
            below = mine[n][0] if n < len(mine) else 0.0
            if p >= 0.5 and hit / n >= precision and below < p:
                least[k] = max(0.5, (p + below) / 2)
    trees = model._java_obj.trees()
    _JUDGES[app] = Judge([_read(t.rootNode()) for t in trees], [float(w) for w in model.treeWeights], least)
    return _JUDGES[app]


def _mask(spans: Column, digit) -> Column:
    """array<string>: a sign for each code point up to the last span's end, in strings of BLOCK signs: digit
    of the span that covers it, else 0. Spans are in order and apart, so an overlap with another span is a
    look-up in a few strings however many spans and signs there are."""

    def part(x: Column, y: Column) -> Column:
        return F.concat(F.repeat(F.lit("0"), x["s"] - F.coalesce(y, F.lit(0))), F.repeat(digit(x), x["e"] - x["s"]))

    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["e"]))
    signs = F.array_join(F.zip_with(spans, F.slice(ends, F.lit(1), F.size(spans)), part), "")
    return F.regexp_extract_all(signs, F.lit(f".{{1,{BLOCK}}}"), F.lit(0))


def _highest(mask: Column, c: Column) -> Column:
    """The highest sign of a mask under a span."""
    first, last = F.floor(c["s"] / BLOCK).cast("int"), F.floor((c["e"] - 1) / BLOCK).cast("int")
    under = F.substring(F.array_join(F.slice(mask, first + 1, last - first + 1), ""), c["s"] % BLOCK + 1, c["e"] - c["s"])
    return F.array_max(F.split(F.concat(F.lit("0"), under), ""))


def personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with pii_base and pii_spans: array<struct<k, s, e>> in order of kind (email, ip, card,
    phone), start and end, in code points with the end exclusive.

    pii_base: what the base patterns find; those of different kinds may overlap. pii_spans: those, and the
    candidates that the trees take, but for such as overlap a base span, or a candidate of another kind
    that is surer by a ninth of the scale, or as sure and of a kind listed before. Null and empty texts have
    no spans; work grows with a text's length and its matches. Columns with these names are replaced. No
    documents: no rows."""
    model = judge(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = {c.lower() for c in docs.columns}
    free = lambda stem: next(n for n in (f"__{stem}{i or ''}" for i in range(99)) if n not in names)
    base, covered, rival, wide, taken = [free(f"base_{k}") for k in KINDS], [free(f"covered_{k}") for k in KINDS], [free(f"rival_{k}") for k in KINDS], free("wide"), free("taken")
    out = docs.withColumns({**{n: base_spans(text, k) for n, k in zip(base, KINDS, strict=True)}, wide: candidates(text)})
    out = out.withColumn(taken, F.when(F.size(wide) > 0, model.taken(F.col(wide))))
    some = F.size(taken) > 0
    masks = {m: F.when(some, _mask(F.col(b), lambda x: F.lit("9"))) for m, b in zip(covered, base, strict=True)}
    masks |= {m: F.when(some, _mask(F.filter(F.col(taken), lambda c, k=k: c["k"] == k), lambda x: x["d"])) for k, m in enumerate(rival)}
    out = out.withColumns(masks)

    def stays(c: Column) -> Column:
        free_of = [_highest(F.col(m), c) == "0" for m in covered]
        for k, m in enumerate(rival):
            other = _highest(F.col(m), c)
            free_of.append((c["k"] == k) | (other < c["d"]) | ((other == c["d"]) & (c["k"] < k)))
        return reduce(lambda x, y: x & y, free_of)

    more = F.transform(F.filter(F.col(taken), stays), lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e")))
    more = F.when(some, more).otherwise(F.expr("cast(array() as array<struct<k:int,s:int,e:int>>)"))
    return out.withColumns({"pii_base": F.concat(*base), "pii_spans": F.array_sort(F.concat(*base, more))}).drop(*base, *covered, *rival, wide, taken)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of personal data in ``text_col`` replaced by [EMAIL], [IP], [CARD] or
    [PHONE]; where spans of two kinds overlap, the one that begins first stands for both."""
    out = personal_data(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.array_sort(F.transform("pii_spans", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"))))
    mark = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, c: Column) -> Column:
        add = F.concat(acc["out"], F.substring(text, acc["at"] + 1, c["s"] - acc["at"]), F.element_at(mark, c["k"] + 1))
        return F.when(c["s"] >= acc["at"], F.struct(c["e"].alias("at"), add.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], c["e"]).alias("at"), acc["out"].alias("out")))

    clean = F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
    return out.withColumn(text_col, F.when(F.size("pii_spans") > 0, clean).otherwise(F.col(text_col))).drop("pii_base", "pii_spans")


def listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.element_at(name, c["k"] + 1), c["s"].cast("string"), c["e"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and hash of the base spans, and all spans listed."""
    out = personal_data(docs.select(id_col, text_col), text_col)

    def number(k: int) -> Column:
        return F.size(F.filter("pii_base", lambda c: c["k"] == k)).cast("long")

    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select(id_col, *counts, F.sha2(listed(F.col("pii_base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"))
