"""What the tasks pick out of a payload while they walk it once, so that its values are neither written nor sent by key."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

from ..functions.text import plain_compact, plain_text


class Number(str):
    """A number, as it is written."""


def values(told: str) -> Iterator[tuple[int, str, str | None, str, str]]:
    """(depth, path, name, kind, text) of every value of a payload (JSON that Spark wrote), in the order of a walk from the top; objects
    and lists without their text, and of numbers only that they are such. An element of a list carries the list's name."""
    todo: list[tuple] = [(0, "$", None, json.loads(told, parse_int=Number, parse_float=Number))]
    while todo:
        depth, path, name, v = todo.pop()
        kind = type(v)
        if kind is dict:
            yield depth, path, name, "OBJECT", ""
            todo += [(depth + 1, f"{path}.{k}", k, x) for k, x in reversed(v.items())]
        elif kind is list:
            yield depth, path, name, "ARRAY", ""
            todo += [(depth + 1, f"{path}[{i}]", name, v[i]) for i in range(len(v) - 1, -1, -1)]
        elif kind is Number:
            yield depth, path, name, "NUMBER", str(v)
        elif kind is str:
            yield depth, path, name, "STRING", v
        elif v is None:
            yield depth, path, name, "VOID", "null"
        else:
            yield depth, path, name, "BOOLEAN", "true" if v else "false"


class Card:
    """Token and title among the values below one object; the rules of json_token and json_title."""

    def __init__(self, root: str, names: Sequence[str], link: str, titles: Sequence[str]):
        self.root, self.names, self.link, self.titles = root, names, link, titles
        self.direct = self.linked = self.anywhere = None
        self.nested = False
        self.at: dict[str, dict[str, str]] = {}

    def see(self, path: str, name: str | None, low: str, kind: str, text: str) -> None:
        """``path`` is that from the object's root, $; ``low`` is the name in lower case."""
        if kind == "OBJECT":
            self.nested |= path == "$.data"
        elif kind != "ARRAY":
            if self.direct is None and low in self.names and kind != "BOOLEAN":
                self.direct = plain_text(text) or None
            if self.anywhere is None and low == "title":
                self.anywhere = plain_text(text) or None
            if kind == "STRING":
                if self.linked is None and "/" in text and (found := re.search(self.link, text)):
                    self.linked = found[1]
                if name in self.titles and (root := path[: -len(name) - 1]) in ("$", "$.data") and (t := plain_text(text)):
                    here = self.at.setdefault(root, {})
                    here[name] = min(t, here.get(name, t))

    def token(self, form: str) -> str | None:
        return self.direct if self.direct is not None and re.search(form, self.direct) else self.linked

    def title(self, fallback: str) -> str:
        here = self.at.get("$.data" if self.nested else "$", {})
        return next((here[n] for n in self.titles if n in here), None) or self.anywhere or fallback


def cards(told: str, path: str, form: str, card: tuple, fallback: str) -> list[tuple[str, str]]:
    """(token, title) of the cards of a payload (json_cards), in their order."""
    found: list[tuple[bool, Card]] = []
    above: list[tuple[int, Card]] = []  # the items that a value lies in
    for depth, at, name, kind, text in values(told):
        while above and above[-1][0] >= depth:
            above.pop()
        low = name.lower() if name else ""
        for _, item in above:
            item.see("$" + at[len(item.root) :], name, low, kind, text)
        if kind == "OBJECT" and at.endswith("]"):
            above.append((depth, Card(at, *card)))
            found.append((re.sub(r"\[[0-9]+\]$", "", at) == path, above[-1][1]))
    named = [(listed, t, item) for listed, item in found if (t := item.token(form)) is not None]
    best = any(listed for listed, _, _ in named)
    first: dict[str, Card] = {}
    for listed, token, item in named:
        if listed == best:
            first.setdefault(token, item)
    return [(token, item.title(fallback)) for token, item in first.items()]


_DIGIT = re.compile(r"\d")


class Labelled:
    """An object's label and the values that may be its price, by the order of their names; the rules of json_price."""

    TOLD = ("title", "label", "name", "key")
    ASKED = ("value", "number", "value_raw", "raw_value", "price")

    def __init__(self):
        self.told: dict[str, str] = {}
        self.asked: dict[str, tuple[bool, str]] = {}

    def see(self, name: str, kind: str, text: str, currency: str) -> None:
        if name in self.TOLD and text not in ("", "0", "false", "null"):
            self.told[name] = text
        if name in self.ASKED and kind in ("STRING", "NUMBER"):
            self.asked[name] = (True, f"{text} {currency}") if kind == "STRING" else (False, text)

    def prices(self, label: str) -> list[tuple[bool, str]]:
        if not self.asked or not self.told:
            return []
        told = plain_text(next(self.told[n] for n in self.TOLD if n in self.told))
        return [self.asked[n] for n in self.ASKED if n in self.asked] if label in told or "price" in told.lower() else []


def listing(told: str, form: str, card: tuple, fallback: str, first: dict[str, Sequence[str]], priced: tuple[Sequence[str], str, str], image: tuple[str, str], most: int = 30_000) -> tuple:
    """(token, title, all_text, all_text compact, title compact, image_url, [(worded, text) that may tell the price, best first], *the
    ``first`` values) of a payload with the objects card and detail; the rules of json_token, json_title, json_all_text, json_image, json_price and
    json_first_value."""
    names, label, currency = priced
    columns: dict[str, list[str]] = {}
    for column, asked in first.items():
        for n in asked:
            columns.setdefault(n, []).append(column)
    own, more = (Card(root, *card) for root in ("$.card", "$.detail"))
    parts = [(own.root, own), (more.root, more)]
    detailed = False
    once: dict[str, None] = {}
    length = 0
    picture = None
    found: dict[str, str] = {}
    texts, numbers, objects = [], [], []
    inside: list[Labelled | None] = []  # by depth, the object that a value lies in
    for depth, at, name, kind, text in values(told):
        low = name.lower() if name else ""
        for root, part in parts:
            if at.startswith(root) and at[len(root) : len(root) + 1] in ("", ".", "["):
                part.see("$" + at[len(root) :], name, low, kind, text)
                break
        detailed = detailed or at == "$.detail"
        del inside[depth:]
        inside.append(Labelled() if kind == "OBJECT" else None)
        if kind in ("OBJECT", "ARRAY"):
            objects += [inside[-1]] * (kind == "OBJECT")
            continue
        for column in columns.get(low, ()):
            if column not in found and text.strip(" "):
                found[column] = " ".join(text.split())
        if depth and inside[depth - 1] is not None and not at.endswith("]"):
            inside[depth - 1].see(name, kind, text, currency)
        if kind == "NUMBER" and low in names:
            numbers.append((False, text))
        if kind == "STRING":
            plain = plain_text(text)
            if plain and plain not in once and length < most:
                once[plain] = None
                length += len(plain)
            if ("price" in at.lower() or label in text or currency in text) and _DIGIT.search(text):  # no price without one
                texts.append((True, text))
            if picture is None and text.startswith("http") and re.search(image[0], low) and re.search(image[1], text):
                picture = text
    top = more if detailed else own
    title = top.title(fallback)
    token = own.token(form)
    prices = [*texts, *(p for x in objects for p in x.prices(label)), *numbers]
    if title == fallback:
        title = own.title(fallback)
    if token is None:
        token = top.token(form)
    return token, title, "\n".join(once) if once else None, plain_compact(" ".join(once)), plain_compact(title), picture, prices, *(found.get(c) for c in first)
