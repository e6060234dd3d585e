"""JSON payloads as a source: a walk over any document, cards, texts, prices and first values."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsers import plausible_price, price_peer
from ..functions.text import let, normalize_text, plain_compact, plain_text, squeeze
from .picks import cards, listing
from .scratch import written


def json_walk(payloads: DataFrame, key: str, payload: str, depth: int = 8) -> DataFrame:
    """key, pos (array of positions; its order is the order of a walk from the top), path, name, kind, text of every value.

    A payload that is no JSON, or null, has no values. Each is parsed once: a level puts the members of objects and lists beside
    what is known so far, ``depth`` levels make one plan, and its values are written. Where some lie deeper, the next plan starts from
    the last level, until one holds no object or list.
    """
    level = payloads.select(F.col(key), F.expr(f"try_parse_json(`{payload}`)").alias("v")).filter("v is not null")
    level = _opened(level.selectExpr(f"`{key}`", "cast(array() as array<int>) pos", "'$' path", "cast(null as string) name", "v", "cast(null as string) kind", "cast(null as string) text"), key)
    out = None
    while True:
        for _ in range(depth):
            level = _opened(level.select(key, F.inline(F.expr(f"concat(array({_SELF}), {_MEMBERS})"))), key)
        text = F.expr("coalesce(text, cast(try_variant_get(v, '$', 'string') as string), to_json(v))")
        level = written(level.select(key, "pos", "path", "name", "kind", text.alias("text"), F.when(F.col("open"), F.col("v")).alias("v"), "open"))
        told = level.select(key, "pos", "path", "name", "kind", "text")
        rest = level.filter("open")
        if out is not None:  # the values that this plan started from are there already
            told = told.filter(F.size("pos") > size)
        out = told if out is None else out.unionByName(told)
        if rest.isEmpty():
            return out
        size = rest.agg(F.max(F.size("pos"))).first()[0]
        level = rest.withColumn("text", F.lit(None).cast("string"))


def _opened(level: DataFrame, key: str) -> DataFrame:
    """Values with their kind, and whether they are objects or lists whose members aren't there yet."""
    kind = F.expr("coalesce(kind, split_part(split_part(schema_of_variant(v), '<', 1), '(', 1))")
    return level.select(key, "pos", "path", "name", "v", kind.alias("kind"), "text").withColumn("open", F.col("text").isNull() & F.col("kind").isin("OBJECT", "ARRAY"))


#: A value whose members are beside it, and those members.
_NODE = "named_struct('pos', {}, 'path', {}, 'name', {}, 'v', {}, 'kind', {}, 'text', {})"
_MEMBER = lambda path, name, v: _NODE.format("array_append(pos, i)", path, name, v, "cast(null as string)", "cast(null as string)")
_SELF = _NODE.format("pos", "path", "name", "case when not open then v end", "kind", "case when open then to_json(v) else text end")
_MEMBERS = f"""case when open and kind = 'OBJECT' then transform(map_entries(cast(v as map<string, variant>)), (e, i) -> {_MEMBER("concat(path, '.', e.key)", "e.key", "e.value")})
  when open then transform(cast(v as array<variant>), (e, i) -> {_MEMBER("concat(path, '[', i, ']')", "name", "e")}) else array() end"""


def json_all_text(walk: DataFrame, key: str, max_chars: int = 30_000) -> DataFrame:
    """key, all_text: the distinct normalised strings in walk order, one a line, up to the one that reaches max_chars."""
    strings = walk.filter("kind = 'STRING'").select(key, "pos", normalize_text(F.col("text")).alias("text")).filter("text <> ''")
    once = strings.groupBy(key, "text").agg(F.min("pos").alias("pos"))
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = once.withColumn("before", before).filter(F.col("before") < max_chars)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("all_text"))


#: A token, and the link of a listing that holds one.
TOKEN, TOKEN_LINK = r"^[A-Za-z0-9_-]{5,}$", r"/v/(?:[^/]+/)?([A-Za-z0-9_-]{5,})"
#: Names that a token has; those of a title in their order, and what stands for a title.
TOKEN_NAMES, TITLE_NAMES, NO_TITLE = ("token", "post_token"), ("title", "header", "name"), "آگهی خودرو"


def json_token(walk: DataFrame, key: Sequence[str], names: Sequence[str] = TOKEN_NAMES, link: str = TOKEN_LINK) -> DataFrame:
    """key and token: the first value under one of the names if it has the form of a token, else that of the first link to a listing."""
    scalar = ~F.col("kind").isin("OBJECT", "ARRAY", "BOOLEAN") & (normalize_text(F.col("text")) != "")
    direct = F.min(F.when(scalar & F.lower("name").isin(*names), F.struct("pos", normalize_text(F.col("text")).alias("t"))))["t"]
    linked = F.min(F.when((F.col("kind") == "STRING") & F.col("text").rlike(link), F.struct("pos", F.regexp_extract("text", link, 1).alias("t"))))["t"]
    out = walk.groupBy(*key).agg(direct.alias("direct"), linked.alias("linked"))
    return out.select(*key, F.when(F.col("direct").rlike(TOKEN), F.col("direct")).otherwise(F.col("linked")).alias("token")).filter("token is not null")


def json_title(walk: DataFrame, key: Sequence[str], fallback: str = NO_TITLE, names: Sequence[str] = TITLE_NAMES, relative: str = "path") -> DataFrame:
    """key and title: a string under one of the names, in their order, directly in the object (in its object ``data``, if it has
    one); else the first value named title at any depth; else the fallback. ``relative`` is the path from the object's root, $."""
    rel, text = F.col(relative), normalize_text(F.col("text"))
    nested = F.max((rel == "$.data") & (F.col("kind") == "OBJECT"))
    stage = lambda root: F.min(F.coalesce(*[F.when((F.col("kind") == "STRING") & (text != "") & (rel == f"{root}.{n}"), F.struct(F.lit(i).alias("i"), text.alias("t"))) for i, n in enumerate(names)]))["t"]
    scalar = ~F.col("kind").isin("OBJECT", "ARRAY") & (F.lower("name") == "title") & (text != "")
    out = walk.groupBy(*key).agg(nested.alias("nested"), stage("$.data").alias("inner"), stage("$").alias("outer"), F.min(F.when(scalar, F.struct("pos", text.alias("t"))))["t"].alias("any"))
    return out.select(*key, F.coalesce(F.when(F.col("nested"), F.col("inner")).otherwise(F.col("outer")), "any", F.lit(fallback)).alias("title"))


#: Parts of the names of pictures, the form of their links, and their hosts.
IMAGE_NAMES, IMAGE_FORM, IMAGE_HOSTS = ("image", "thumbnail", "src", "url"), r"(?i)\.(?:jpg|jpeg|png|webp)(?:\?|$)", ("divarcdn",)


def json_image(walk: DataFrame, key: str, parts: Sequence[str] = IMAGE_NAMES, hosts: Sequence[str] = IMAGE_HOSTS) -> DataFrame:
    """key and image_url: the first http string under a name with one of the parts that ends like a picture or lies on one of the hosts."""
    named = F.coalesce(F.lower("name").rlike("|".join(parts)), F.lit(False))
    picture = F.col("text").rlike(IMAGE_FORM) | F.col("text").rlike("|".join(hosts))
    hits = walk.filter((F.col("kind") == "STRING") & F.col("text").startswith("http") & named & picture)
    return hits.groupBy(key).agg(F.min_by("text", "pos").alias("image_url"))


def json_cards(payloads: DataFrame, key: str, payload: str, path: str = "$.web_widgets.post_list", depth: int = 8) -> DataFrame:
    """key, pos, token, title of the cards of a payload: the items of the list at ``path``; if none of them is a card, the items of
    any list that have a token.

    Token and title are looked for below the item (json_token, json_title); a token counts once in a payload, the first by
    position, and pos numbers its cards. A task walks each payload once, to its last level (``depth`` is for json_walk's callers),
    and returns its cards: nothing is written, and nothing sent by key.
    """
    card = (TOKEN_NAMES, TOKEN_LINK, TITLE_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, tokens, titles = [], [], [], []
            for i, told in enumerate(batch.column(1).to_pylist()):
                for n, (token, title) in enumerate(cards(told, path, TOKEN, card, NO_TITLE) if told else ()):
                    at.append(i)
                    pos.append(n)
                    tokens.append(token)
                    titles.append(title)
            told = [pa.array(pos, pa.int32()), pa.array(tokens, pa.string()), pa.array(titles, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *told], names=["key", "pos", "token", "title"])

    rows = payloads.select(F.col(key).alias("key"), as_json(F.col(payload)).alias("told"))
    out = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, pos int, token string, title string")
    return out.withColumnRenamed("key", key)


def as_json(payload: Column) -> Column:
    """A payload as Spark writes it, members in the order of their names; null where it is no JSON."""
    return F.to_json(F.try_parse_json(payload))


def json_first_value(walk: DataFrame, key: str, names: Sequence[str], value: str = "value") -> DataFrame:
    """key and the first non-empty string or number, in walk order, under one of the names."""
    hits = walk.filter(F.lower("name").isin(*names) & ~F.col("kind").isin("OBJECT", "ARRAY") & (F.trim("text") != ""))
    return hits.groupBy(key).agg(F.min_by(squeeze(F.col("text")), "pos").alias(value))


#: Names of prices, the word of their labels and that of their currency.
PRICE_NAMES, PRICE_LABEL, CURRENCY = ("price", "price_value", "pricevalue"), "قیمت", "تومان"


def json_price(walk: DataFrame, key: str, names: Sequence[str] = PRICE_NAMES, currency: str = CURRENCY, label: str = PRICE_LABEL, low: int = 30_000_000, high: int = 100_000_000_000) -> DataFrame:
    """key, price: texts on price-like paths first, then values of objects with a price-like label, then numbers under price-like
    names; each in walk order."""
    number = plausible_price(F.floor(F.col("text").try_cast("double")).cast("bigint"), low, high)
    numeric = ~F.col("kind").isin("STRING", "OBJECT", "ARRAY", "BOOLEAN", "VOID")
    like = F.lower("path").contains("price") | F.contains("text", F.lit(label)) | F.contains("text", F.lit(currency))
    by_text = F.when((F.col("kind") == "STRING") & like, price_peer(F.col("text"), low, high))
    by_number = F.when(numeric & F.lower("name").isin(*names), number)
    priced = let(by_text, lambda p: F.struct(F.when(p.isNotNull(), 1).otherwise(3).alias("stage"), F.coalesce(p, by_number).alias("price")))
    # Generated, so that the filter doesn't read the prices a second time.
    staged = walk.filter(numeric | (F.col("kind") == "STRING")).select(key, "pos", F.inline(F.filter(F.array(priced), lambda x: x["price"].isNotNull())))
    staged = staged.unionByName(_labelled_prices(walk, key, currency, label, low, high).withColumn("stage", F.lit(2)))
    return staged.groupBy(key).agg(F.min_by("price", F.struct("stage", "pos")).alias("price"))


def _labelled_prices(walk: DataFrame, key: str, currency: str, label: str, low: int, high: int) -> DataFrame:
    """key, pos, price of the objects whose label (the first of title, label, name and key that isn't empty) is price-like: the first
    of value, number, value_raw, raw_value and price that is a price."""
    at = lambda names: F.coalesce(*[F.when(F.col("name") == n, F.lit(i)) for i, n in enumerate(names)])
    told, asked = at(("title", "label", "name", "key")), at(("value", "number", "value_raw", "raw_value", "price"))
    worded = price_peer(F.concat("text", F.lit(f" {currency}")), low, high)
    numbered = plausible_price(F.floor(F.col("text").try_cast("double")).cast("bigint"), low, high)
    price = F.when(F.col("kind") == "STRING", worded).when(~F.col("kind").isin("OBJECT", "ARRAY", "BOOLEAN", "VOID"), numbered)
    # Only the fields of objects: an element of a list carries the list's name.
    fields = walk.filter((told.isNotNull() | asked.isNotNull()) & ~F.col("path").endswith("]") & ~F.col("kind").isin("OBJECT", "ARRAY"))
    fields = fields.select(key, F.expr("slice(pos, 1, greatest(0, size(pos) - 1))").alias("pos"), told.alias("told"), asked.alias("asked"), F.col("text"), price.alias("price"))
    objects = fields.groupBy(key, "pos").agg(
        F.min_by("text", F.when(F.col("told").isNotNull() & ~F.coalesce("text", F.lit("")).isin("", "0", "false", "null"), F.col("told"))).alias("label"),
        F.min_by("price", F.when(F.col("price").isNotNull(), F.col("asked"))).alias("price"),
    )
    worded = normalize_text(F.col("label"))
    return objects.filter((F.contains(worded, F.lit(label)) | F.lower(worded).contains("price")) & F.col("price").isNotNull()).select(key, "pos", "price")


def json_listing(told: Column, first: dict[str, Sequence[str]], low: int = 30_000_000, high: int = 100_000_000_000) -> tuple[Column, Callable[[Column], Column]]:
    """What listings are built of, from a payload with the objects card and detail (of as_json): struct(token, title, all_text,
    compact and title_compact (what compact_text makes of all_text and title), image_url, prices and the ``first`` values, by their columns), and the price of such a struct's prices.

    Each is what json_token, json_title, json_all_text, json_image, json_price and json_first_value tell of a walk, but a task walks a
    payload once. The first of ``prices``, in the order of json_price, that is a price counts.
    """
    card = (TOKEN_NAMES, TOKEN_LINK, TITLE_NAMES)
    priced, image = (PRICE_NAMES, PRICE_LABEL, CURRENCY), ("|".join(IMAGE_NAMES), f"{IMAGE_FORM}|(?:{'|'.join(IMAGE_HOSTS)})")
    worded = pa.list_(pa.struct([("worded", pa.bool_()), ("text", pa.string()), ("compact", pa.string())]))
    kinds = {"token": pa.string(), "title": pa.string(), "all_text": pa.string(), "compact": pa.string(), "title_compact": pa.string(), "image_url": pa.string(), "prices": worded} | {c: pa.string() for c in first}
    fields = ", ".join(f"{c}: {'array<struct<worded: boolean, text: string, compact: string>>' if k == worded else 'string'}" for c, k in kinds.items())

    @F.arrow_udf(f"struct<{fields}>")
    def run(payloads: pa.Array) -> pa.Array:
        rows = [listing(x, TOKEN, card, NO_TITLE, first, priced, image) if x else (None,) * len(kinds) for x in payloads.to_pylist()]
        columns = dict(zip(kinds, zip(*rows, strict=True), strict=True)) if rows else dict.fromkeys(kinds, ())
        columns["prices"] = [None if x is None else [{"worded": w, "text": plain_text(t), "compact": plain_compact(plain_text(t))} for w, t in x] for x in columns["prices"]]
        return pa.StructArray.from_arrays([pa.array(columns[c], k) for c, k in kinds.items()], names=list(kinds))

    def price(prices: Column) -> Column:
        number = lambda t: plausible_price(F.floor(t.try_cast("double")).cast("bigint"), low, high)
        each = F.transform(prices, lambda x: F.when(x["worded"], price_peer(x["text"], low, high, compact=x["compact"])).otherwise(number(x["text"])))
        return F.get(F.filter(each, lambda p: p.isNotNull()), 0)

    return run.asNondeterministic()(told), price  # else a filter on it is run before rows are dealt, a second time
