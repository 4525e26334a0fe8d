"""Personal data in texts, by weak supervision, with DataFrame functions only.

Strict patterns give the base spans, which always stay. Looser patterns give candidates. On each candidate
four labelers vote yes, no or nothing: the strict form, a gazetteer (top-level domains, calling codes, card
issuers), words before it, and its structure (check digits, digit counts). Expectation-maximisation over
the counts of vote patterns estimates how reliable each labeler is and how likely each pattern is to be
personal data; with those soft labels a logistic classifier over votes and shape is fitted, and the
candidates that it accepts are added. Votes have few values, so the tables that the driver fits on are
bounded (81 patterns a kind, 324 with the shapes) whatever the size of the corpus, and counts cover all of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismloom.llm.storage import table

KINDS = ("email", "ip", "card", "phone")
#: A kind without base spans: keys, tokens and passwords. It comes after the others.
ALL_KINDS = (*KINDS, "secret")

#: The strict patterns, in forms that take linear time: a run is tried from its start or the end of the last
#: match only, and loops are possessive where nothing that follows could use what they give back.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Found in every text with a match that could stay; texts without are not searched further.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}

#: Words that name a telephone number or a password right before it.
_DIALLED = r"(?i:call|phone|tel|telephone|telefon|t[eé]l[eé]phone|tel[eé]fono|mobile|mobil|handy|fax|whatsapp|ring)"
_PASSWORD = r"(?i:password|passwd|passphrase|pwd|passwort|contraseña|mot\x20de\x20passe)"
#: Looser forms: spelt-out addresses, IPv6, cards of 13 to 19 digits, numbers without a plus (national ones only after a word
#: that names them; four digits before 00 are an account's); long words with a digit, and shorter ones said to be passwords.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9][\x20().0-9-]{6,20}[0-9]|(?<![0-9]{4}\x20)00[1-9][\x20().0-9-]{6,18}[0-9]|0[1-9](?<=(?<![A-Za-z0-9])" + _DIALLED + r"[.:]{0,2}\x20{0,2}0[1-9])[\x20/0-9-]{5,14}[0-9]|\(0?[0-9]{2,4}\)\x20?[0-9]{3,4}[\x20.-][0-9]{3,4}|0?[0-9]{2,3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_/+=.@-])(?=[A-Za-z_/+=-]*+[0-9])[A-Za-z0-9_/+=-]{16,}+(?![.@])|(?<=[:=]|[:=]\x20)(?<=(?<![A-Za-z0-9])" + _PASSWORD + r"\x20?[:=]\x20?)(?=[^\s\"'<>,;]{0,40}[0-9])[^\s\"'<>,;]{6,}+",
}
LOOSE_HINT = {"email": r"@|[\[(]at[\])]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]::?[0-9A-Fa-f]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]|[0-9)][\x20./-][0-9]|0[1-9][0-9]{6}", "secret": r"[A-Za-z0-9_/+=-]{16}|" + _PASSWORD + r"\x20?[:=]"}

#: Gazetteers. Top-level domains of two letters are countries' or shaped like theirs; calling codes by zone.
DOMAINS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "coop", "museum", "aero", "jobs", "mobi", "travel", "tel", "asia", "cat", "app", "dev", "page", "cloud", "online", "site", "store", "shop", "tech", "blog", "news", "email", "mail", "live", "life", "world", "xyz", "top", "club", "agency", "group", "solutions", "systems", "services", "media", "digital", "design", "studio", "bank", "law", "health", "academy", "school", "university", "berlin", "london", "paris", "tokyo", "swiss", "eus", "bzh", "example", "test", "local")
CALLING = r"1|7|2[07]|2[1-69][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]|8[1246]|8[058][0-9]|9[0-58]|9[679][0-9]"
PREFIXES = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|pk_live_|rk_live_|xox[abeprs]-|AIza|ya29|eyJ|SG_|npm_|pypi-|hf_)"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|62)"
#: Words that speak for or against a kind when they stand before a candidate.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|courriel|correo|from|to|kontakt)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|client|adresse|direcci[oó]n|remote)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|karte|carte|tarjeta|pay(?:ment)?)\b",
    "phone": r"(?i)\b(?:call|phone|tel|telefon|t[eé]l[eé]phone|tel[eé]fono|mobile|fax|whatsapp|ring)\b",
    "secret": r"(?i)(?:\b|_)(?:tokens?|secret|api[ _-]?key|access[ _-]?key|private[ _-]?key|pass(?:word|wd|phrase)?|pwd|bearer|auth(?:orization)?|credentials?|contraseña|passwort|mot de passe)\b",
}
COUNTER_CUES = r"(?i)\b(?:isbn|issn|order|invoice|version|release|id|ref|serial|sku|part|build|doi|page|sha\d*|md5|commit|checksum|etag|uuid)\b"
#: Characters before a candidate in which cues count.
CONTEXT = 40
LABELERS = ("strict", "gazetteer", "context", "structure")
SHAPES = 4


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row even where lambdas use it again and again."""
    return F.transform(F.array(value), use)[0]


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _before(sizes: Column, i: Column, sums: Column, block: int) -> Column:
    """Sum of the first i sizes, by whole blocks and the rest."""
    whole = F.floor(i / block).cast("int")
    return _sum(F.slice(sums, 1, whole)) + _sum(F.slice(sizes, whole * block + 1, i - whole * block))


def found(text: Column, pattern: str, hint: str, block: int = 256) -> Column:
    """Leftmost non-overlapping matches as (start, end, hit) structs, in code points.

    Splitting at the pattern gives the text between matches, whose lengths say where matches stand.
    """
    kind = "array<struct<start: int, end: int, hit: string>>"

    def spans(both: Column) -> Column:
        sizes = F.zip_with(F.slice(both["gaps"], 1, F.size(both["hits"])), both["hits"], lambda g, h: F.length(g) + F.length(h))

        def placed(sizes: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / block).cast("int")), lambda b: _sum(F.slice(sizes, b * block + 1, block)))
            return let(sums, lambda sums: F.transform(both["hits"], lambda h, i: let(_before(sizes, i + 1, sums, block), lambda end: F.struct((end - F.length(h)).alias("start"), end.alias("end"), h.alias("hit")))))

        return F.when(F.size(both["hits"]) > 0, let(sizes, placed))

    searched = let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), spans)
    return F.coalesce(F.when(text.rlike(hint), searched), F.array().cast(kind)).cast(kind)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    last_first = F.split(F.reverse(number), "")
    value = lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((2 * x.cast("int")) % 10 + F.floor(x.cast("int") / 5).cast("int"))
    return _sum(F.transform(F.filter(last_first, lambda x: x != ""), value)) % 10 == 0


def _parts_fit(hit: Column) -> Column:
    small = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))
    return F.forall(F.split(hit, r"\."), small)


def holds(kind: str, hit: Column) -> Column:
    """Whether a match of the strict pattern is a base span."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _parts_fit(hit)
    number = F.length(digits(hit))
    if kind == "card":
        return number.between(16, 19) & luhn(digits(hit))
    return number.between(8, 15)


def base(text: Column, kind: str) -> Column:
    if kind not in STRICT:
        return F.array().cast("array<struct<start: int, end: int, hit: string>>")
    return F.filter(found(text, STRICT[kind], HINT[kind]), lambda m: holds(kind, m["hit"]))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, text: Column, span: Column, strict: Column) -> dict[str, Column]:
    """The labelers' votes on a candidate, and its shape."""
    hit, number = span["hit"], digits(span["hit"])
    before = F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT)))
    is_base = F.exists(strict, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
    if kind == "email":
        top = F.lower(F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1))
        gazetteer = _vote(top.isin(*DOMAINS) | top.rlike("^[a-z]{2}$"), top.rlike("[0-9-]"))
        structure = _vote(F.length(top).between(2, 24) & (F.length(hit) <= 254), F.length(top) < 2)
        spelt = hit.rlike(r"[\[(]")
    elif kind == "ip":
        six = hit.contains(":")
        gazetteer = _vote(hit.rlike(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|2001|fe80|fc|fd)[.:]"), hit.rlike(r"^0[.:]"))
        structure = _vote(six | _parts_fit(hit), ~six & ~_parts_fit(hit))
        spelt = six
    elif kind == "card":
        gazetteer = _vote(number.rlike(ISSUERS), ~number.rlike(ISSUERS))
        structure = _vote(luhn(number), ~luhn(number))
        spelt = hit.rlike("[ -]")
    elif kind == "secret":
        gazetteer = _vote(hit.rlike(PREFIXES), hit.rlike("^[0-9]+$|[/=-]{2}|^[a-z]+-[a-z]+"))
        hexadecimal = hit.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$")
        mixed = hit.rlike("[A-Z]") & hit.rlike("[a-z]") & (F.length(number) >= 3)
        structure = _vote(hexadecimal | mixed, ~hit.rlike(PREFIXES) & ((F.length(number) < 3) | (F.length(number) > F.length(hit) - 3) | hit.rlike("^[A-Za-z_-]+[0-9]+$")))
        told = before.rlike(_PASSWORD + r"\x20?[:=]\x20?$")
        structure = F.when(told, 1).otherwise(structure)
        spelt = hit.rlike("[_/+=-]")
    else:
        code = F.regexp_replace(hit, "[^0-9+]", "")
        gazetteer = _vote(code.rlike(r"^(?:\+|00)(?:" + CALLING + ")"), code.rlike(r"^(?:\+|00)"))
        structure = _vote(F.length(number).between(9, 15), ~F.length(number).between(8, 15))
        spelt = hit.rlike(r"[ ().-]")
    context = _vote(before.rlike(CUES[kind]), before.rlike(COUNTER_CUES))
    shape = F.when(spelt, 1).otherwise(0) + F.when(F.length(hit) > 16, 2).otherwise(0)
    return {"strict": F.when(is_base, 1).otherwise(-1), "gazetteer": gazetteer, "context": context, "structure": structure, "shape": shape}


def candidates(text: Column, kind: str, strict: Column) -> Column:
    """Candidates as (start, end, strict, gazetteer, context, structure, shape) structs."""
    return F.transform(found(text, LOOSE[kind], LOOSE_HINT[kind]), lambda m: F.struct(m["start"], m["end"], *(v.cast("int").alias(n) for n, v in votes(kind, text, m, strict).items())))


@dataclass
class Model:
    """What was learnt of a kind: how often a labeler votes so on either class, and the classifier's weights."""

    prior: float = 0.5
    rates: dict[tuple[str, int], tuple[float, float]] = field(default_factory=dict)
    weights: dict[tuple[str, int], float] = field(default_factory=dict)
    bias: float = 0.0


def fit_reliabilities(patterns: dict[tuple[int, ...], float], rounds: int = 30) -> tuple[Model, dict[tuple[int, ...], float]]:
    """Expectation-maximisation over vote patterns with counts; the model, and each pattern's probability.

    Votes of different labelers are taken as independent given the class. The start is the share of yes
    among the votes cast; the strict labeler, which is right by construction when it says yes, holds its
    class.
    """
    model = Model()
    chance = {p: 0.5 + sum(p) / (2 * len(p) + 1) for p in patterns}
    for _ in range(rounds):
        chance = {p: 1.0 if p[0] == 1 else min(max(c, 1e-6), 1 - 1e-6) for p, c in chance.items()}
        yes = 1 + sum(n * chance[p] for p, n in patterns.items())
        no = 1 + sum(n * (1 - chance[p]) for p, n in patterns.items())
        model.prior = yes / (yes + no)
        for i, name in enumerate(LABELERS):
            for vote in (-1, 0, 1):
                mass = [(n, chance[p]) for p, n in patterns.items() if p[i] == vote]
                # A little more weight for what the vote says keeps labelers from changing sides.
                model.rates[name, vote] = ((1 + 2 * (vote == 1) + sum(n * c for n, c in mass)) / (yes + 4), (1 + 2 * (vote == -1) + sum(n * (1 - c) for n, c in mass)) / (no + 4))
        for p in patterns:
            odds = math.log(model.prior / (1 - model.prior)) + sum(math.log(a / b) for name, v in list(zip(LABELERS, p, strict=True))[1:] for a, b in [model.rates[name, v]])
            chance[p] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return model, {p: 1.0 if p[0] == 1 else c for p, c in chance.items()}


def fit_classifier(model: Model, rows: list[tuple[tuple[int, ...], int, float]], chance: dict[tuple[int, ...], float], rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> None:
    """Logistic regression of soft labels on votes and shape, by gradient descent over counted patterns.

    The strict labeler is left out: the classifier is for spans that it doesn't know.
    """
    total = sum(n for *_, n in rows) or 1.0
    parts = [([*zip(LABELERS[1:], p[1:], strict=True), ("shape", s)], chance[p], n / total) for p, s, n in rows]
    model.weights = {f: 0.0 for fs, *_ in parts for f in fs}
    model.bias = 0.0
    for _ in range(rounds):
        slope, slope_bias = {f: ridge * w for f, w in model.weights.items()}, 0.0
        for fs, label, share in parts:
            score = model.bias + sum(model.weights[f] for f in fs)
            error = share * (1 / (1 + math.exp(-max(-30, min(30, score)))) - label)
            slope_bias += error
            for f in fs:
                slope[f] += error
        model.bias -= rate * slope_bias
        for f, g in slope.items():
            model.weights[f] -= rate * g


def fit(docs: DataFrame, text: str = "text") -> dict[str, Model]:
    """Models of all kinds, from the candidates of all documents."""
    body = F.coalesce(F.col(text), F.lit(""))

    def named(kind: str) -> Column:
        as_pattern = lambda c: F.struct(F.lit(kind).alias("kind"), *(c[n].alias(n) for n in (*LABELERS, "shape")))
        return let(base(body, kind), lambda strict: F.transform(candidates(body, kind, strict), as_pattern))

    counts = docs.select(F.explode(F.concat(*map(named, ALL_KINDS))).alias("c")).groupBy("c").count()
    rows = [(r["c"], r["count"]) for r in counts.collect()]  # at most 5 x 81 x 4 patterns
    models = {}
    for kind in ALL_KINDS:
        own = [(tuple(c[n] for n in LABELERS), c["shape"], float(n)) for c, n in rows if c["kind"] == kind]
        patterns: dict[tuple[int, ...], float] = {}
        for p, _, n in own:
            patterns[p] = patterns.get(p, 0.0) + n
        models[kind], chance = fit_reliabilities(patterns)
        fit_classifier(models[kind], own, chance)
    return models


def accepted(model: Model, c: Column, cut: float) -> Column:
    """Whether the classifier takes a candidate: its probability reaches the cut."""
    score = F.lit(model.bias)
    for (name, value), weight in sorted(model.weights.items()):
        score = score + F.when(c[name] == value, weight).otherwise(0.0)
    # A structure that can't be right rules a candidate out, whatever else speaks for it.
    return (score >= math.log(cut / (1 - cut))) & (c["structure"] != -1)


def find(docs: DataFrame, text: str = "text", cut: float = 0.5, models: dict[str, Model] | None = None) -> DataFrame:
    """Adds ``base`` and ``spans``: arrays of (kind, start, end), by kind as listed, then start.

    Places are code points, ends exclusive. A null text is as an empty one and has no spans; repeated
    documents get the same spans each. All other columns stay, whatever their names, but the two must be new names. An empty
    table gives no rows. An added span overlaps no base span of its kind; a secret overlaps no base span of any kind.
    """
    if {"base", "spans"} & set(docs.columns):
        raise ValueError("columns base or spans are there already")
    own = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*own.values())
    models = fit(rows, own[text]) if models is None else models
    body = F.coalesce(F.col(own[text]), F.lit(""))

    def both(kind: str) -> Column:
        plain = lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))

        def split(strict: Column) -> Column:
            more = F.filter(candidates(body, kind, strict), lambda c: (c["strict"] == -1) & (accepted(models[kind], c, cut) if kind in models else F.lit(False)))
            return F.struct(F.transform(strict, plain).alias("own"), F.transform(more, plain).alias("more"))

        return let(base(body, kind), split)

    out = rows.withColumns({f"found_{kind}": both(kind) for kind in ALL_KINDS})
    strict = F.concat(*(F.col(f"found_{kind}.own") for kind in KINDS))
    apart = F.filter("found_secret.more", lambda s: ~F.exists(strict, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    every = [F.array_sort(F.concat(F.col(f"found_{kind}.own"), F.col(f"found_{kind}.more") if kind != "secret" else apart)) for kind in ALL_KINDS]
    return out.select(*(F.col(o).alias(c) for c, o in own.items()), strict.alias("base"), F.concat(*every).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return spans.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))


QUERIES = {"op9_pii": op9_pii}
ORACLE_SQL: dict[str, str] = {}
