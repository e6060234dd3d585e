"""Validation: ordered reject reasons, catalogue checks, duplicates across sources, outbox."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import parsers as P
from ..functions import text as T
from ..sources import payloads as PL
from ..sources.scratch import written


def listing_reason(rows: DataFrame, as_of_year: int, blocked: Sequence[str] = L.HISTORY_BLOCKED, required: Sequence[tuple[str, str]] = L.HISTORY_TRIM_REQUIRED) -> DataFrame:
    """Rows (source, source_ad_id, url, title, raw_text) with their parsed fields and ``reason``: the first of blocked_phrase,
    invalid_price, invalid_year, unknown_vehicle, missing_trim, unknown_condition that holds, else accepted."""
    text = F.concat_ws("\n", "title", "raw_text")
    out = rows.withColumn("clean_url", T.canonical_url(F.col("url"))).select("*", F.explode(F.array(T.normalize_match(text))).alias("_t"))
    plain = {"normalized": True}
    out = out.withColumn("_named", F.concat_ws(" ", F.col("_t"), T.normalize_match(F.col("clean_url"))))
    out = out.withColumn("_hits", P.vehicle_hits(F.col("_named"), **plain))
    # Generated once a row, so that no later filter or column computes the fields again.
    fields = F.struct(
        *(c.alias(n) for n, c in {
            "_b": T.first_phrase(F.col("_t"), [P._plain_match(p) for p in blocked]),
            "price": P.parse_price(F.col("_t"), **plain),
            "model_year": F.coalesce(P.parse_year(F.col("_t"), **plain), P.year_from_url(F.col("clean_url"))),
            "_v": P.vehicle_identity(F.col("_named"), **plain, hits=F.col("_hits")),
            "mileage": P.parse_mileage(F.col("_t"), **plain),
        }.items())
    )
    out = out.select("*", F.inline(F.array(fields))).select("*", "_v.*").drop("_v")
    condition = P.classify_condition(F.col("_t"), F.col("mileage"), **plain)
    aged = P.aged_condition(condition, F.col("model_year"), as_of_year)
    out = out.select("*", F.explode(F.array(F.when(F.col("source") == "formula", aged).otherwise(condition))).alias("condition"))
    needs = F.concat_ws("\t", "brand", "model").isin(*["\t".join(p) for p in required])
    reason = (
        F.when(F.col("_b").isNotNull(), F.concat(F.lit("blocked_phrase:"), F.col("_b")))
        .when(F.col("price").isNull(), "invalid_price")
        .when(F.col("model_year").isNull(), "invalid_year")
        .when(F.col("brand").isNull() | F.col("model").isNull(), "unknown_vehicle")
        .when(needs & (F.col("trim") == ""), "missing_trim")
        .when(F.col("condition") == "unknown", "unknown_condition")
        .otherwise("accepted")
    )
    listed_id = F.coalesce(F.nullif(T.strip(F.col("source_ad_id")), F.lit("")), F.substring(F.sha2(F.col("clean_url").cast("binary"), 256), 1, 24))
    return out.withColumns({"reason": reason, "source_ad_id": listed_id}).drop("_t", "_b", "_named", "_hits")


def batch_listing(rows: DataFrame, text: str = "text", models: Sequence[str] = L.BATCH_MODELS, excluded: Sequence[str] = L.BATCH_EXCLUDED) -> DataFrame:
    """Batch-mean pipeline: name, year, price, mileage, zero flag and reason (excluded phrase, no_price or accepted)."""
    t = F.col(text)
    out = rows.withColumns({"car_name": T.earliest_alias(t, models), "model_year": P.year_batch(t), "price": P.price_batch(t), "mileage": P.mileage_batch(t), "is_zero_km": P.is_zero_km(t), "_x": T.first_phrase(t, excluded)})
    return out.withColumn("reason", F.when(F.col("_x").isNotNull(), F.concat(F.lit("excluded:"), "_x")).when(F.col("price").isNull(), "no_price").otherwise("accepted")).drop("_x")


def validate_ad(title: Column, text: Column, price: Column, blocked: Sequence[str] = L.GROUP_BLOCKED) -> Column:
    """Group-mean pipeline: missing_title, blocked_phrase, invalid_price or accepted."""
    hit = T.first_phrase(T.normalize_match_any(F.concat_ws(" ", title, text)), blocked)
    return F.when(F.coalesce(T.normalize_match_any(title), F.lit("")) == "", "missing_title").when(hit.isNotNull(), F.concat(F.lit("blocked_phrase:"), hit)).when(price.isNull() | (price <= 0), "invalid_price").otherwise("accepted")


def catalog_check(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows with known_model, needs_trim and valid, against a catalogue (brand, model, trims array; a small dimension that Spark
    broadcasts by its size). A trim must be listed, if the model has trims and one is given."""
    c = catalog.select(F.col("brand").alias("_b"), F.col("model").alias("_m"), "trims")
    out = rows.join(c, (F.col("brand") == F.col("_b")) & (F.col("model") == F.col("_m")), "left")
    listed = F.coalesce(F.size("trims") > 0, F.lit(False))
    fine = (F.coalesce("trim", F.lit("")) == "") | ~listed | F.coalesce(F.array_contains("trims", F.col("trim")), F.lit(False))
    return out.withColumns({"known_model": F.col("_b").isNotNull(), "needs_trim": listed, "valid": F.col("_b").isNotNull() & fine}).drop("_b", "_m", "trims")


def eligible(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows with an id, a positive price and a valid vehicle, with its trim where the model has trims."""
    out = catalog_check(rows.filter((F.trim("ad_id") != "") & (F.col("price") > 0)), catalog)
    return out.filter(F.col("valid") & (~F.col("needs_trim") | (F.coalesce("trim", F.lit("")) != ""))).drop("known_model", "needs_trim", "valid")


def cross_source_duplicates(rows: DataFrame, stored: DataFrame, key: str, print_: str = "fingerprint") -> DataFrame:
    """Rows whose key is not stored but whose fingerprint is."""
    fresh = rows.join(stored.select(key), key, "left_anti")
    return fresh.join(stored.select(print_).distinct(), print_, "left_semi")


def contained_first(texts: DataFrame, table: DataFrame, text: str, value: str) -> DataFrame:
    """(text, value) of the distinct texts that contain a key of the table (ord, key, value): that of the first by ord.

    A key is filed under that of its pieces of three characters which the fewest texts hold; one of fewer characters, under
    itself. A text is told by its distinct pieces of those sizes, one row a place, which meet the index in a join that Spark
    broadcasts if the table is small: what comes out follows the rare pieces, for tables of any size.
    """
    keyed = table.filter("key is not null").select("ord", "key", value)
    sizes = sorted(r[0] for r in keyed.select(F.least(F.length("key"), F.lit(3)).alias("n")).distinct().collect())  # four at most
    pieces = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(c, i, n))
    of_text = F.array_distinct(F.concat(F.array().cast("array<string>"), *[pieces(F.col(text), n) if n else F.array(F.lit("")) for n in sizes]))
    spread = texts.select(text).distinct().filter(F.col(text).isNotNull()).withColumn("_piece", F.explode(of_text))
    of_key = F.when(F.length("key") >= 3, F.array_distinct(pieces(F.col("key"), 3))).otherwise(F.array("key"))
    cut = keyed.withColumn("_piece", F.explode(of_key))
    counts = spread.join(cut.select("_piece").distinct(), "_piece", "left_semi").groupBy("_piece").agg(F.count("*").alias("_n"))
    rarest = F.min(F.struct(F.coalesce("_n", F.lit(0).cast("long")).alias("n"), F.col("_piece").alias("piece")))["piece"]
    filed = written(cut.join(counts, "_piece", "left").groupBy("ord", "key", value).agg(rarest.alias("_piece")))
    hits = spread.join(filed, "_piece").filter(F.contains(F.col(text), F.col("key")))
    return hits.groupBy(text).agg(F.min_by(value, "ord").alias(value))


def substring_lookup(names: DataFrame, table: DataFrame, name: str = "name") -> DataFrame:
    """names with the price of the first table row (ord, key, price) by ord whose key the name contains; null without one."""
    return names.join(contained_first(names, table, name, "price"), name, "left")


def price_list_table(messages: DataFrame, models: Sequence[str] | DataFrame, dash: str = "—|–") -> DataFrame:
    """name, price of the lines ``name — price`` of price-list messages (msg_id, text): the first model in the name, the number in
    the last part (below 10 000: millions); the first line of a model counts. Models are a list, or a table (ord, key) of any
    size."""
    lines = messages.select("msg_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    parts = F.split("line", dash)
    number = P.parse_integer(P.group(F.element_at(parts, -1), r"([۰-۹0-9][۰-۹0-9,،.٬\s]{0,10}[۰-۹0-9]|[۰-۹0-9]{3,6})"))
    rows = lines.filter(F.size(parts) >= 2).select("msg_id", "pos", F.element_at(parts, 1).alias("part"), number.alias("n")).filter("n > 0")
    if isinstance(models, DataFrame):
        rows = rows.join(contained_first(rows, models.select("ord", "key", F.col("key").alias("name")), "part", "name"), "part")
    else:
        rows = rows.withColumn("name", T.first_phrase(F.col("part"), models)).filter("name is not null")
    rows = rows.withColumn("price", F.when(F.col("n") < 10_000, F.col("n") * 1_000_000).otherwise(F.col("n")))
    return rows.groupBy("name").agg(F.min_by("price", F.struct("msg_id", "pos")).alias("price"))


def build_listings(payloads: DataFrame, key: str, card: str, detail: str, seen_at: str, rules: Sequence[tuple[str, str]] = (), stored: DataFrame | None = None, url: str = "https://divar.ir/v/a/", depth: int = 8) -> DataFrame:
    """Listings of the peer-median pipeline from a card and a detail payload (JSON, the latter may be null), one a row.

    Token, title, texts, price, city, district and picture come from one walk over both, made where the row lies (``depth`` is for
    json_walk's callers); year, mileage, body class, exclusion and
    severe damage from all their texts. A listing is also excluded if its model key has fewer than two characters or it has no
    price. ``stored`` (token, first_seen) keeps the first_seen of what is known. Rows without a token are left out.
    """
    first = {"city": ("city_persian", "city_name", "city", "city_title", "city_slug"), "district": ("district_persian", "district_name", "district", "neighborhood", "neighbourhood")}
    alone = F.concat(F.lit('{"card":'), F.col(card), F.lit("}"))
    both = F.concat(F.lit('{"card":'), F.col(card), F.lit(',"detail":'), F.col(detail), F.lit("}"))
    read = lambda whole, told: F.struct(whole.alias("_json"), told.alias("_told"))
    # Generated once a row, so that no later column parses a payload again; a detail that is no JSON is left out.
    whole = T.let(PL.as_json(both), lambda told: F.when(told.isNotNull(), read(both, told)).otherwise(read(alone, PL.as_json(alone))))
    rows = payloads.select(key, F.inline(F.array(whole)))
    found, price = PL.json_listing(F.col("_told"), first)
    out = rows.withColumn("_found", found).filter("_found.token is not null").select(key, "_json", "_found.*").withColumnRenamed("all_text", "_text")
    text = F.coalesce("_text", F.lit(""))
    # As normalised, and as compact, as the parsers would make it.
    plain, small = F.replace(text, F.lit("\n"), F.lit(" ")), F.coalesce("compact", F.lit(""))
    named = F.trim(F.concat_ws(" ", "title_compact", small))
    compact = lambda c, phrases: T.first_phrase(c, [P._plain_compact(p) for p in phrases])
    fields = {
        "price_toman": price(F.col("prices")),
        "model_key": P.model_key(F.col("title_compact"), rules, compacted=True),
        "year": P.year_peer(plain, normalized=True),
        "mileage": P.mileage_peer(plain, normalized=True),
        "body_class": P.severity_class(small, compacted=True),
        "_why": P.exclusion_reason(named, compacted=True),
        "severe_damage": compact(small, L.SEVERE_DAMAGE_PHRASES).isNotNull(),
    }
    out = out.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))))
    unnamed = F.when(F.length("model_key") < 2, "unknown_model")
    reason = F.coalesce("_why", unnamed, F.when(F.col("price_toman").isNull(), "no_price_found"))
    now = F.lit(seen_at).cast("timestamp")
    if stored is not None:
        out = out.join(stored.select("token", F.col("first_seen").alias("_known")), "token", "left")
    seen = F.coalesce("_known", now) if stored is not None else now
    return out.select(key, "token", "title", "model_key", "year", "mileage", "body_class", "price_toman", "city", "district", F.concat(F.lit(url), "token").alias("url"), "image_url", F.substring(text, 1, 20_000).alias("description"), reason.isNotNull().alias("excluded"), reason.alias("excluded_reason"), "severe_damage", seen.alias("first_seen"), now.alias("last_seen"), F.substring("_json", 1, 200_000).alias("source_json"))


#: Distinct texts that are few in any case (they are broadcast), and texts that a task reads.
FEW_TEXTS, TASK_TEXTS = 1 << 17, 50_000


def group_listings(rows: DataFrame, title: str, description: str, stated: Sequence[str | None] = (None, None, None, None)) -> DataFrame:
    """rows with brand, model, trim, model_year and mileage of the group-mean pipeline; all null where no vehicle was found.

    ``stated`` names the columns with the brand, model, trim and year that a page states itself. A vehicle needs a year. What rows
    have in common is read once: their distinct texts are written and read, and rows ask for theirs. Where more than half of the
    rows have a text of their own, each row is read where it lies.
    """
    keys = list(dict.fromkeys(c for c in (title, description, *stated) if c))
    texts = written(rows.select(*keys).distinct())
    n = texts.count()
    if n > FEW_TEXTS and 2 * n > rows.count():
        return _group_told(rows, title, description, stated)
    dealt = texts.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_TEXTS)))
    told = _group_told(dealt.withColumns({f"_k{i}": F.col(k) for i, k in enumerate(keys)}), title, description, stated)
    told = told.select(*[f"_k{i}" for i in range(len(keys))], *[F.col(c).alias(f"_told_{c}") for c in GROUP_FIELDS])
    same = [rows[k].eqNullSafe(told[f"_k{i}"]) for i, k in enumerate(keys)]
    out = rows.join(F.broadcast(told) if n <= FEW_TEXTS else told, same, "left")
    return out.withColumns({c: F.col(f"_told_{c}") for c in GROUP_FIELDS}).drop(*[c for c in told.columns])


#: What group_listings adds.
GROUP_FIELDS = ("brand", "model", "trim", "model_year", "mileage")


def _group_told(rows: DataFrame, title: str, description: str, stated: Sequence[str | None]) -> DataFrame:
    """rows with GROUP_FIELDS, each read for itself."""
    column = lambda c: F.col(c) if c else F.lit(None).cast("string")
    brand, model, trim, year = map(column, stated)
    own = P.GroupIdentity()
    # Each step is computed once a row: forms by a generator, what is found in them by one pass in Python.
    forms = own.forms(F.col(title), F.col(description), brand, model, trim)
    out = rows.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in forms.items()]))).alias("_f"))
    hits = own.hits({n: F.col(f"_f.{n}") for n in forms})
    out = out.withColumns({f"_h_{n}": h for n, h in hits.items()})
    both = F.concat_ws(" ", *[F.nullif(F.col(f"_f.{n}"), F.lit("")) for n in ("title", "description")])
    identity = own.named({n: F.col(f"_h_{n}") for n in hits}, brand, model, trim)
    fields = F.struct(identity.alias("v"), F.coalesce(P.normalize_year(year), P.year_group(both, normalized=True)).alias("y"), P.mileage_group(both, normalized=True).alias("m"))
    out = out.select("*", F.explode(F.array(fields)).alias("_x")).drop("_f", *[f"_h_{n}" for n in hits])
    known = F.col("_x.v").isNotNull() & F.col("_x.y").isNotNull()
    told = {"brand": "_x.v.brand", "model": "_x.v.model", "trim": "_x.v.trim", "model_year": "_x.y", "mileage": "_x.m"}
    return out.withColumns({n: F.when(known, F.col(c)) for n, c in told.items()}).drop("_x")


def unique_canonical(values: DataFrame, lexicon: DataFrame, value: str, form: str = "form", canonical: str = "canonical") -> DataFrame:
    """values with the canonical of the one lexicon row (form, canonical) whose form equals theirs; null if none or several do."""
    only = lexicon.groupBy(form).agg(F.count("*").alias("_n"), F.min(canonical).alias(canonical)).filter("_n = 1").select(F.col(form).alias("_form"), canonical)
    return values.join(only, F.col(value) == F.col("_form"), "left").drop("_form")


def outbox(deals: DataFrame, title: Column, percent: Column, most: int = 4000) -> DataFrame:
    """ad_id and a message for each deal, HTML-escaped, cut to ``most`` characters; delivery is someone else's."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = [F.concat(F.lit("Below market: "), escape(title)), F.concat(F.lit("Price: "), F.format_number("price", 0)), F.concat(F.lit("Below: "), percent.cast("string"), F.lit(" bp"))]
    return deals.select("ad_id", F.substring(F.concat_ws("\n", *lines), 1, most).alias("message"))


def run_counters(rows: DataFrame, source: str, status: str) -> DataFrame:
    count = lambda s: F.count_if(F.col(status) == s)
    return rows.groupBy(source).agg(F.count("*").alias("fetched"), count("accepted").alias("accepted"), count("duplicate").alias("duplicates"), (F.count("*") - count("accepted") - count("duplicate")).alias("rejected"))


def run_totals(rows: DataFrame, run: str, status: str, errors: DataFrame | None = None) -> DataFrame:
    """fetched, accepted, rejected, duplicates of each run, with its status: failed if the run is among ``errors`` (run, error),
    partial if it rejected all it fetched, else ok; the error is cut to 2000 characters."""
    out = run_counters(rows, run, status)
    if errors is None:
        return out.withColumns({"status": _run_status(F.lit(None)), "error": F.lit(None).cast("string")})
    told = errors.groupBy(run).agg(F.max("error").alias("error"))
    out = out.join(told, run, "left").withColumn("error", F.nullif(F.substring("error", 1, 2000), F.lit("")))
    return out.withColumn("status", _run_status(F.col("error")))


def _run_status(error: Column) -> Column:
    return F.when(error.isNotNull(), "failed").when(F.col("accepted") + F.col("duplicates") == 0, "partial").otherwise("ok")
