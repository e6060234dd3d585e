"""Field parsers as Column functions: ordered patterns, the first that gives an acceptable value decides."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as L
from .automaton import Lexicon
from .text import compact_text, first_phrase, keep, let, normalize_digits, normalize_match, normalize_match_any, normalize_text

MILLION, BILLION = 1_000_000, 1_000_000_000


def group(text: Column, pattern: str, k: int = 1) -> Column:
    """A group of the first match; empty without a match."""
    return F.regexp_extract(text, pattern, k)


def _matchable(text: Column, normalized: bool) -> Column:
    return text if normalized else normalize_match(text)


def parse_integer(c: Column) -> Column:
    """Without separators (comma, Arabic comma and thousands mark, dot, white space); null unless digits are left."""
    cleaned = F.regexp_replace(normalize_digits(c), r"[,،٬.\s]", "")
    return F.regexp_extract(cleaned, "^([0-9]+)$", 1).try_cast("bigint")


def between(c: Column, low: int, high: int) -> Column:
    return keep(c, lambda x: x.between(low, high))


def looks_like_phone(c: Column) -> Column:
    return F.regexp_replace(normalize_digits(c, arabic=False), r"\s", "").rlike(L.BATCH_PHONE)


def price_batch(text: Column) -> Column:
    """Batch-mean pipeline: w/fff, billions, millions, a currency amount of a million or more, a short suffix, a label."""
    # A pattern is tried only where the text holds its words, which is told much faster.
    has = lambda *words: reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])
    fraction = lambda k: parse_integer(group(text, L.BATCH_PRICE_FRACTION, k))
    scaled = lambda pattern, by: keep(parse_integer(group(text, pattern)), lambda n: n > 0) * by
    amount = lambda pattern: keep(group(text, pattern), lambda x: (x != "") & ~looks_like_phone(x))
    return F.coalesce(
        F.when(has("قیمت") & has("/"), (fraction(1) * 1000 + fraction(2)) * MILLION),
        F.when(has("میلیارد", "ملیارد"), scaled(L.BATCH_BILLIONS, BILLION)),
        F.when(has("میلیو", "ملیون", "میليون"), scaled(L.BATCH_MILLIONS, MILLION)),
        F.when(has("تومان"), keep(parse_integer(amount(L.BATCH_TOMANS)), lambda n: n >= MILLION)),
        keep(parse_integer(amount(L.BATCH_SHORT_PRICE)), lambda n: n.between(1, 99_999)) * MILLION,
        F.when(has("قیمت", "فروش", "مبلغ"), let(parse_integer(amount(L.BATCH_LABELLED_PRICE)), lambda n: F.when(n >= MILLION, n).when(n > 0, n * MILLION))),
    )


def plausible_price(value: Column, low: int = 30 * MILLION, high: int = 100 * BILLION) -> Column:
    """The value, or a tenth of it, if that lies in the range."""
    return let(value, lambda v: F.when(v.between(low, high), v).otherwise(between(F.floor(v / 10).cast("bigint"), low, high)))


def price_peer(text: Column, low: int = 30 * MILLION, high: int = 100 * BILLION, compact: Column | None = None) -> Column:
    """Peer-median pipeline: the first pattern that parses decides, plausible or not; decimals are read. With ``compact``, its compact
    form, the text is a normalised one."""
    # A pattern is tried only where the text holds its word.
    number = lambda t, word, p: F.when(F.contains(t, F.lit(word)), F.translate(group(t, p), "٫٬, ", ".").try_cast("double"))
    found = let(
        normalize_text(text) if compact is None else text,
        lambda t: F.coalesce(
            number(t, "میلیارد", L.PEER_BILLIONS) * BILLION,
            number(t, "میلیون", L.PEER_MILLIONS) * MILLION,
            number(t, "تومان", L.PEER_TOMANS),
        ),
    )
    told = lambda v: F.when(v.isNotNull() & let(compact_text(text) if compact is None else compact, lambda t: first_phrase(t, L.NO_PRICE_PHRASES)).isNull(), plausible_price(v, low, high))
    return let(found.cast("bigint"), told)


def parse_price(text: Column, currency: str = "تومان|تومن", billion: str = "میلیارد|ملیارد", million: str = "میلیون|ملیون", no_price: Sequence[str] = ("توافقی", "تماس بگیرید", "قیمت در تماس", "قیمت تماس"), low: int = MILLION, high: int = 500 * BILLION, normalized: bool = False) -> Column:
    """Prior-history pipeline: a currency amount, billions, millions, or a bare number of 7 to 12 digits, each within the range."""
    def amount(t: Column, most: str, words: str, by: int) -> Column:
        # Numbers go up to the word, which begins with none of their characters, so a run is never tried shorter; texts without
        # the word are only searched.
        number = group(t, rf"([0-9][0-9,،٬.\s]{{{most}}}+)\s*(?:{words})")
        return F.when(t.rlike(words), between(parse_integer(number) * by, low, high))

    def found(t: Column) -> Column:
        bare = F.transform(F.regexp_extract_all(t, F.lit(r"(?<![0-9])([0-9]{7,12})(?![0-9])"), F.lit(1)), lambda x: x.cast("bigint"))
        first = F.coalesce(
            amount(t, "5,22", currency, 1),
            amount(t, "0,18", billion, BILLION),
            amount(t, "0,18", million, MILLION),
            F.get(F.filter(bare, lambda x: x.between(low, high)), 0),
        )
        return F.when(first_phrase(t, no_price).isNull(), first) if no_price else first

    return let(_matchable(text, normalized), found)


def price_card(parts: Column, currency: str = "تومان|تومن") -> Column:
    """Group-mean pipeline: the parts of a card from the last to the first; else a bare number within 100 000 to 100 billion."""
    known = lambda a: F.get(F.filter(a, lambda x: x.isNotNull()), 0)
    priced = lambda ps: F.transform(F.filter(ps, lambda p: p.rlike(currency)), lambda p: parse_integer(group(p, r"([0-9][0-9,،٬.\s]*+)")))
    bare = lambda ps: F.transform(ps, lambda p: between(parse_integer(group(p, r"^\s*+([0-9][0-9,،٬.]{2,18})\s*+$")), 100_000, 100 * BILLION))
    return let(F.transform(F.reverse(parts), lambda p: normalize_digits(p)), lambda ps: F.coalesce(known(priced(ps)), known(bare(ps))))


def _full_year(raw: Column) -> Column:
    n = raw.try_cast("int")
    return F.when(
        F.length(raw) == 2, F.when(n.between(70, 99), n + 1300).when(n.between(0, 30), n + 1400)
    ).when(n.between(1300, 1499) | n.between(2000, 2100), n)


def parse_year(text: Column, label: str = "مدل|سال", normalized: bool = False) -> Column:
    """Prior-history pipeline: labelled years of 2 to 4 digits, then bare ones; the first acceptable counts."""
    raw = let(_matchable(text, normalized), lambda t: F.concat(F.regexp_extract_all(t, F.lit(rf"(?:{label})\s*([0-9]{{2,4}})"), F.lit(1)), F.regexp_extract_all(t, F.lit(r"(?<![0-9])(13[0-9]{2}|14[0-9]{2}|20[0-9]{2})(?![0-9])"), F.lit(1))))
    return F.get(F.filter(F.transform(raw, _full_year), lambda y: y.isNotNull()), 0)


def year_from_url(url: Column) -> Column:
    path = F.regexp_extract(normalize_digits(url), r"^(?:[^:/?#]+://[^/?#]*)?([^?#]*)", 1)
    return F.get(F.reverse(F.filter(F.transform(F.regexp_extract_all(path, F.lit(r"(?:^|[-_/])(13[0-9]{2}|14[0-9]{2}|20[0-9]{2})(?=$|[-_/])"), F.lit(1)), _full_year), lambda y: y.isNotNull())), 0)


def year_batch(text: Column) -> Column:
    """Batch-mean pipeline: a labelled year only, as a string."""

    def read(raw: Column) -> Column:
        n = raw.try_cast("int")
        four = F.when(n.between(1300, 1499) | n.between(2000, 2099), raw)
        two = F.when(n.between(0, 30), n + 1400).when(n.between(70, 99), n + 1300).cast("string")
        return F.when(F.length(raw) == 4, four).when(F.length(raw) == 2, two)

    return let(group(normalize_digits(text, arabic=False), L.BATCH_YEAR), read)


def year_peer(text: Column, normalized: bool = False) -> Column:
    """Peer-median pipeline: a labelled year, else the first solar year, else the first year."""

    def found(t: Column) -> Column:
        labelled = group(t, L.PEER_LABELLED_YEAR).try_cast("int")
        years = F.transform(F.regexp_extract_all(t, F.lit(L.PEER_YEAR), F.lit(1)), lambda x: x.cast("int"))
        return let(years, lambda ys: F.coalesce(labelled, F.get(F.filter(ys, lambda y: y.between(1300, 1499)), 0), F.get(ys, 0)))

    return let(text if normalized else normalize_text(text), found)


def normalize_year(c: Column) -> Column:
    """Group-mean pipeline: two digits are 13xx, three 1xxx, four as they are."""
    n = parse_integer(c)
    return F.when(n.between(0, 99), n + 1300).when(n.between(100, 999), n + 1000).when(n.between(1300, 1499) | n.between(2000, 2100), n).cast("int")


def parse_mileage(text: Column, label: str = "کارکرد", zero: str = "صفر", units: str = "کیلومتر|کیلو|km", zero_units: str = "کیلومتر|km", normalized: bool = False) -> Column:
    """Prior-history pipeline: zero phrases, a labelled number, a number with a unit; within 0 to 2 000 000."""
    word = r"[\p{L}\p{N}_]"
    none = rf"{label}\s*{zero}(?:\s*(?:{zero_units}))?|(?<!{word}){zero}\s*(?:{zero_units})(?!{word})|(?<![0-9])0\s*(?:{zero_units})(?!{word})"
    number = lambda t, p: between(parse_integer(group(t, p)), 0, 2 * MILLION)
    found = lambda t: F.coalesce(number(t, rf"{label}\s*([0-9][0-9,،٬.\s]{{0,15}})(?:\s*(?:{units}))?"), number(t, rf"([0-9][0-9,،٬.\s]{{1,15}}+)\s*(?:{units})"))
    return let(_matchable(text, normalized), lambda t: F.when(t.rlike(none), F.lit(0).cast("bigint")).otherwise(found(t)))


def mileage_batch(text: Column) -> Column:
    """Batch-mean pipeline; w/fff counts thousands."""
    fraction = lambda k: parse_integer(group(text, L.BATCH_MILEAGE_FRACTION, k))
    plain = between(parse_integer(group(text, L.BATCH_MILEAGE)), 0, 2 * MILLION)
    found = F.coalesce(F.when(F.contains(text, F.lit("/")), fraction(1) * 1000 + fraction(2)), plain)
    return F.when(F.contains(text, F.lit("کارکرد")), F.when(text.rlike(L.BATCH_NO_MILEAGE), F.lit(0).cast("bigint")).otherwise(found))


def mileage_peer(text: Column, normalized: bool = False) -> Column:
    number = lambda t, p: between(F.regexp_replace(group(t, p), "[٬, ]", "").try_cast("bigint"), 0, 2 * MILLION)
    found = lambda t: F.when(t.rlike(L.PEER_NO_MILEAGE), F.lit(0).cast("bigint")).otherwise(F.coalesce(*[number(t, p) for p in L.PEER_MILEAGES]))
    return let(text if normalized else normalize_text(text), found)


def is_zero_km(text: Column) -> Column:
    return text.rlike(L.BATCH_ZERO_KM)


def classify_condition(text: Column, mileage: Column, zero: Sequence[str] = ("صفر کیلومتر", "صفرکیلومتر", "کارکرد صفر"), used: Sequence[str] = ("کارکرده", "دست دوم"), normalized: bool = False) -> Column:
    told = let(_matchable(text, normalized), lambda t: F.when(first_phrase(t, zero).isNotNull(), 0).when(first_phrase(t, used).isNotNull(), 1).otherwise(2))
    return F.when(mileage == 0, F.lit("zero")).otherwise(let(told, lambda k: F.when(k == 0, "zero").when((mileage > 0) | (k == 1), "used").otherwise("unknown")))


def aged_condition(condition: Column, year: Column, as_of_year: int, age: int = 2) -> Column:
    """An unknown condition is ``used`` for a year at least ``age`` years back (solar years are 621 behind)."""
    old = (year.between(1300, 1499) & (year <= as_of_year - 621 - age)) | (year.between(2000, 2100) & (year <= as_of_year - age))
    return F.when((condition == "unknown") & old, F.lit("used")).otherwise(condition)


def severity_class(text: Column, classes: dict[str, Sequence[str]] = L.BODY_CLASSES, order: Sequence[str] = L.BODY_ORDER, compact=None, compacted: bool = False) -> Column:
    """The worst class with a phrase in the text; ``unknown`` without one."""
    compact = compact or _plain_compact
    found = lambda t: F.coalesce(*[F.when(first_phrase(t, [compact(p) for p in classes[c]]).isNotNull(), F.lit(c)) for c in order], F.lit("unknown"))
    return let(text if compacted else compact_text(text), found)


def _plain_compact(phrase: str) -> str:
    """What compact_text does, for the phrases of a lexicon."""
    return re.sub(" +", " ", re.sub("[^0-9a-zآ-ی]+", " ", phrase.replace("‌", " ").lower())).strip()


def exclusion_reason(text: Column, finance: Sequence[str] = L.FINANCE_PHRASES, instalment: str = "قسط", no_price: Sequence[str] = L.NO_PRICE_PHRASES, compacted: bool = False) -> Column:
    """Why a listing is left out: a finance phrase, a number of instalments, no price; null if it isn't."""
    listed = lambda t, name, phrases: F.concat(F.lit(f"{name}:"), first_phrase(t, [_plain_compact(p) for p in phrases]))
    found = lambda t: F.coalesce(
        listed(t, "finance", finance),
        F.when(F.contains(t, F.lit(instalment)) & t.rlike(rf"(?:^|\s)[0-9]+\s*{instalment}(?:\s|$)"), F.lit("instalment_count")),
        F.when(F.contains(t, F.lit(instalment)) & t.rlike(rf"(?:^|\s){instalment}\s*[0-9]+"), F.lit("instalment_amount")),
        listed(t, "no_price", no_price),
    )
    return let(text if compacted else compact_text(text), found)


def fingerprint(*fields: Column, title: Column | None = None) -> Column:
    """sha256 of the fields joined by |, nulls as empty, and the first 100 characters of the title."""
    cells = [F.coalesce(f.cast("string"), F.lit("")) for f in fields] + ([F.substring(F.lower(title), 1, 100)] if title is not None else [])
    return F.sha2(F.concat_ws("|", *cells).cast("binary"), 256)


def comparison_key(*fields: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("unknown")) for f in fields])


@lru_cache(4)
def _history_lexicon(models: tuple, trims: tuple) -> tuple[Lexicon, list[int], list[int]]:
    lexicon = Lexicon(_plain_match)
    border = lambda p: "latin" if re.fullmatch("[a-z0-9 ]+", p) else ""
    return lexicon, lexicon.add({a: "\t".join(v) for a, v in models}, border), lexicon.add(dict(trims), border)


def vehicle_hits(text: Column, models=L.HISTORY_MODELS, trims=L.HISTORY_TRIMS, normalized: bool = False) -> Column:
    """The aliases of models and trims in a text, for vehicle_identity."""
    return _history_lexicon(tuple(models.items()), tuple(trims.items()))[0].hits(_matchable(text, normalized))


def vehicle_identity(text: Column, models=L.HISTORY_MODELS, trims=L.HISTORY_TRIMS, normalized: bool = False, hits: Column | None = None) -> Column:
    """struct(brand, model, trim) of the prior-history pipeline: longest aliases, then the rules of four models. ``hits`` may hold
    what vehicle_hits found, in a column of its own."""
    lexicon, of_models, of_trims = _history_lexicon(tuple(models.items()), tuple(trims.items()))

    def ruled(t: Column, pair: Column, trim: Column) -> Column:
        brand, model = F.get(pair, 0), F.get(pair, 1)
        is_ = lambda b, *ms: (brand == b) & model.isin(*ms)
        number = lambda p: F.coalesce(keep(F.regexp_extract(t, p, 1), lambda x: x != ""), trim)
        x55 = F.when(t.rlike("premium|پریمیوم"), F.lit("Premium")).when(t.rlike("(?<![a-z])ie(?![a-z])"), F.lit("IE")).when(t.rlike("pro|پرو"), F.lit("Pro")).otherwise(trim)
        return (
            F.when(brand.isNull(), F.lit(""))
            .when(is_("Peugeot", "Pars") & F.contains(t, F.lit("پارس سال")), F.lit("سال"))
            .when(is_("Saipa", "Pride"), number("(111|131|132|151)"))
            .when(is_("Kia", "Cerato"), number("(1600|2000)"))
            .when(is_("MVM", "X55", "X55 Pro"), x55)
            .otherwise(trim)
        )

    found = vehicle_hits(text, models, trims, normalized) if hits is None else hits
    both = F.struct(_matchable(text, normalized).alias("t"), F.split(lexicon.best(found, of_models), "\t").alias("pair"), F.coalesce(lexicon.best(found, of_trims), F.lit("")).alias("trim"))
    return let(both, lambda x: F.struct(F.get(x["pair"], 0).alias("brand"), F.get(x["pair"], 1).alias("model"), ruled(x["t"], x["pair"], x["trim"]).alias("trim")))


def _plain_match(phrase: str) -> str:
    """What normalize_match does, for the phrases of a lexicon."""
    t = phrase.lower().translate(str.maketrans(L.PERSIAN_DIGITS + "‌يكۀة", L.ASCII_DIGITS + " یکهه"))
    t = re.sub("(?<=[A-Za-zآ-ی])(?=[0-9])|(?<=[0-9])(?=[A-Za-zآ-ی])", " ", t)
    return re.sub(r"\s+", " ", re.sub(r"[_/\\|,:;؛،!?؟()\[\]{}]+", " ", t)).strip()


def model_key(title: Column, rules: Sequence[tuple[str, str]] = (), compacted: bool = False) -> Column:
    """Model key of the peer-median pipeline: years, mileages, colours, body and filler phrases removed; first matching rule."""
    w = r"[\p{L}\p{N}_]"
    t = F.concat(F.lit(" "), title if compacted else compact_text(title), F.lit(" "))
    t = F.regexp_replace(t, r"(?:20[0-9]{2}|1[34][0-9]{2})(?<=[^0-9]....)(?=[^0-9]|$)", " ")
    t = let(t, lambda t: F.when(t.rlike("کیلومتر|km"), F.regexp_replace(t, rf"(?i)(?<!{w})[0-9][0-9,٬ ]*+(?:کیلومتر|km)(?!{w})", " ")).otherwise(t))

    def numbered(t: Column) -> Column:
        for word, number in L.NUMBER_WORDS.items():
            t = F.regexp_replace(t, rf"(?<!{w})تیپ\s+{word}(?!{w})", f"تیپ {number}")
        return t

    t = let(t, lambda t: F.when(t.rlike(rf"تیپ\s+(?:{'|'.join(L.NUMBER_WORDS)})"), numbered(t)).otherwise(t))
    # Spellings of one model.
    for source, target in (("پژو206", "پژو 206"), ("پژو207", "پژو 207"), ("206sd", "206 sd"), ("دناپلاس", "دنا پلاس"), ("سمندال ایکس", "سمند lx"), ("ال نود", "l90"), ("تندر 90", "l90"), ("تندر90", "l90"), ("کوییکآر", "کوییک r"), ("تاراوی 4", "تارا v4"), ("تاراوی 2", "تارا v2")):
        t = F.replace(t, F.lit(source), F.lit(target))
    fillers = sorted([*L.NOISE_PHRASES, *L.COLOUR_PHRASES], key=len, reverse=True)
    body = [p for terms in L.BODY_CLASSES.values() for p in sorted(terms, key=len, reverse=True)]
    for phrase in [*fillers, *body]:
        t = F.replace(t, F.lit(_plain_compact(phrase)), F.lit(" "))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, rf"(?<!{w})(?:مدل|رنگ|کارکرد)(?!{w})", " "), r"\s+", " "))
    return F.coalesce(*[F.when(t.rlike(f"(?i){p}"), F.lit(k)) for p, k in rules], F.substring(t, 1, 160))


def read_model_rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(pattern, key) of a JSON file of rules, a list of objects; entries without either, or whose pattern is none, are left out."""
    rows = spark.read.option("multiLine", True).schema("pattern string, key string").json(path).collect()
    rules = []
    for r in rows:  # a short list by nature: it becomes part of the expression
        try:
            if r.pattern is not None and r.key is not None:
                rules.append((re.compile(r.pattern).pattern, _plain_compact(r.key)))
        except re.error:
            continue
    return rules


def year_group(text: Column, label: str = "مدل|سال", normalized: bool = False) -> Column:
    """Group-mean pipeline: a number after the label, one before it, or a bare one of four digits; the first that is a year."""
    digits = lambda t, p: F.regexp_extract_all(t, F.lit(p), F.lit(1))

    def found(t: Column) -> Column:
        raw = F.concat(digits(t, rf"(?:{label})\s*[:\-]?\s*([0-9]{{2,4}})"), digits(t, rf"([0-9]{{2,4}})\s*(?:{label})"), digits(t, r"(?<![0-9])([0-9]{4})(?![0-9])"))
        return F.get(F.filter(F.transform(raw, normalize_year), lambda y: y.isNotNull()), 0)

    return let(text if normalized else normalize_match_any(text), found)


def year_card(text: Column, label: str = "مدل|سال") -> Column:
    """Group-mean pipeline, text of a card: the first labelled number decides, if it is 0..99 or 1300..1499; else a bare solar year."""
    solar = lambda n: n.between(1300, 1499)

    def found(t: Column) -> Column:
        raw = group(t, rf"(?:{label})\s*[:：\-]?\s*([0-9]{{2,4}})")
        bare = F.get(F.regexp_extract_all(t, F.lit(r"(?<![0-9])(13[0-9]{2}|14[0-9]{2})(?![0-9])"), F.lit(1)), 0)
        return F.when(raw != "", keep(raw.try_cast("int"), lambda n: n.between(0, 99) | solar(n))).otherwise(bare.try_cast("int"))

    return let(normalize_digits(text), found)


def mileage_group(text: Column, label: str = "کارکرد", zero: str = "صفر", units: str = "کیلومتر|کیلو|km", normalized: bool = False) -> Column:
    """Group-mean pipeline: a zero phrase, a labelled number, a number with a unit; within 0 to 2 000 000."""
    number = lambda t, p: between(parse_integer(group(t, p)), 0, 2 * MILLION)
    found = lambda t: F.coalesce(number(t, rf"(?i){label}\s*[:：]?\s*([0-9][0-9,،٬.\s]{{0,15}})\s*(?:{units})?"), number(t, rf"(?i)([0-9][0-9,،٬.\s]{{2,15}})\s*(?:{units})"))
    return let(text if normalized else normalize_match_any(text), lambda t: F.when(t.rlike(rf"{label}\s*[:：]?\s*{zero}"), F.lit(0).cast("bigint")).otherwise(found(t)))


def mileage_card(text: Column, label: str = "کارکرد", units: str = "کیلومتر|کیلو|km") -> Column:
    """Group-mean pipeline, text of a card: the labelled number, within 0 to 2 000 000."""
    return let(normalize_digits(text), lambda t: between(parse_integer(group(t, rf"(?i){label}\s*[:：]?\s*([0-9][0-9,،٬.\s]*)\s*(?:{units})?")), 0, 2 * MILLION))


def unique_value(value: Column, names: Sequence[str]) -> Column:
    """The one name that equals the value when both are normalised; null if none or several do."""
    forms: dict[str, list[str]] = {}
    for name in names:
        forms.setdefault(_plain_match_any(name), []).append(name)
    only = [(form, same[0]) for form, same in forms.items() if form and len(same) == 1]
    if not only:
        return F.lit(None).cast("string")
    book = F.create_map(*[F.lit(x) for pair in only for x in pair])
    return F.try_element_at(book, normalize_match_any(value))


def _plain_match_any(phrase: str) -> str:
    """What normalize_match_any does, for the phrases of a lexicon."""
    t = " ".join(phrase.translate(str.maketrans(L.PERSIAN_DIGITS, L.ASCII_DIGITS)).split()).lower()
    t = t.translate(str.maketrans("يكۀة_/\\|–—", "یکهه    --"))
    t = re.sub(r"[()\[\]{}:؛;،,!?؟]+", " ", t)
    return " ".join(re.sub(r"(?<=[^\W\d_])(?=[0-9])|(?<=[0-9])(?=[^\W\d_])", " ", t).split())


class GroupIdentity:
    """Names of the group-mean pipeline: brand, model and trim from a title, a description and what a page states of them.

    All aliases and the names of trims are phrases of one lexicon with word borders, so that each text is searched once.
    """

    def __init__(self, catalog: Sequence[tuple[str, str, Sequence[str]]] = L.GROUP_CATALOG, brands=L.GROUP_BRANDS, models=L.GROUP_MODELS, trims=L.GROUP_TRIMS, context=L.GROUP_CONTEXT_TRIMS, context_only: Sequence[str] = L.GROUP_CONTEXT_ONLY):
        pick = lambda aliases, names: {a: v for a, v in aliases.items() if v in names}
        self.catalog = catalog
        self.lexicon = Lexicon(_plain_match_any)
        add = lambda aliases: self.lexicon.add(aliases, lambda p: "word")
        self.every = list(dict.fromkeys(m for _, m, _ in catalog))
        self.of = {b: [m for c, m, _ in catalog if c == b] for b in dict.fromkeys(b for b, _, _ in catalog)}
        self.owner = {m: b for m in self.every if len({c for c, n, _ in catalog if n == m}) == 1 for b, n, _ in catalog if n == m}
        self.brands = add(brands)
        self.models = {b: add(pick(models, own)) for b, own in [("", self.every), *self.of.items()]}
        self.trims = {}
        for b, m, listed in catalog:
            own = pick(trims, listed)
            safe = {**own, **{x: x for x in listed if x not in context_only}}
            self.trims[b, m] = listed, add(own), add(context.get((b, m), {})), add(safe)

    def forms(self, title: Column, description: Column, brand: Column, model: Column, trim: Column) -> dict[str, Column]:
        """The texts to be searched, normalised."""
        form = lambda c: normalize_match_any(F.coalesce(c, F.lit("")))
        stated = lambda c: F.when(c.isNotNull(), normalize_match_any(c))
        return {"title": form(title), "description": form(description), "brand": stated(brand), "model": stated(model), "trim": stated(trim)}

    def hits(self, forms: dict[str, Column]) -> dict[str, Column]:
        """What is found in each of the forms, and in title and description as one text. Forms should be columns of their own."""
        both = F.concat_ws(" ", *[F.nullif(forms[c], F.lit("")) for c in ("title", "description")])
        return {c: self.lexicon.hits(x) for c, x in {"title": forms["title"], "text": both, "brand": forms["brand"], "model": forms["model"], "trim": forms["trim"]}.items()}

    def named(self, hits: dict[str, Column], brand: Column, model: Column, trim: Column) -> Column:
        """struct(brand, model, trim) from what was found.

        For each the stated value counts if it is a name of the catalogue, then an alias in it, then an alias in the text. Models
        are those of the brand, if it is known; a model of one brand alone gives the brand. The trim is looked for in the title
        only: first the phrases of its model, then aliases and those names that aren't too short to stand alone. All three are
        null if brand or model stay unknown or don't belong together, or if the model has trims and none was found.
        """
        best = self.lexicon.best

        def by_brand(b: Column, build) -> Column:
            """build(brand, names of the models) for the brand's models; for an unknown brand, for all."""
            out = F.when(b.isNull(), build("", self.every))
            for name, own in self.of.items():
                out = out.when(b == name, build(name, own))
            return out

        def trim_of(h: Column, b: Column, m: Column) -> Column:
            out = F.lit("")
            for (of, name), (listed, own, context, safe) in self.trims.items():
                if listed:
                    found = F.coalesce(unique_value(trim, listed), best(h["trim"], own), best(h["title"], context), best(h["title"], safe))
                    out = F.when((b == of) & (m == name), found).otherwise(out)
            return out

        def model_of(h: Column, b: Column) -> Column:
            return by_brand(b, lambda name, own: F.coalesce(unique_value(model, own), best(h["model"], self.models[name]), best(h["text"], self.models[name])))

        def told(h: Column) -> Column:
            b = F.coalesce(unique_value(brand, list(self.of)), best(h["brand"], self.brands), best(h["text"], self.brands))
            owner = F.create_map(*[F.lit(v) for p in self.owner.items() for v in p])
            return let(b, lambda b: let(model_of(h, b), lambda m: let(F.coalesce(b, F.try_element_at(owner, m)), lambda c: whole(h, c, m))))

        def whole(h: Column, b: Column, m: Column) -> Column:
            known = F.concat_ws("\t", b, m).isin(*[f"{c}\t{n}" for c, n, _ in self.catalog]) & b.isNotNull() & m.isNotNull()
            return let(trim_of(h, b, m), lambda t: F.when(known & t.isNotNull(), F.struct(b.alias("brand"), m.alias("model"), t.alias("trim"))))

        return let(F.struct(*[c.alias(n) for n, c in hits.items()]), told)


def group_identity(title: Column, description: Column, brand: Column, model: Column, trim: Column, **lists) -> Column:
    """struct(brand, model, trim) of the group-mean pipeline, as a single expression; ``lists`` as for GroupIdentity."""
    own = GroupIdentity(**lists)
    return own.named(own.hits(own.forms(title, description, brand, model, trim)), brand, model, trim)
