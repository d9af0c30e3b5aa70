"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page's outline is its stream of block tags and texts, without inline tags and without the parts whose names say they are menus, notices,
adverts and so on. Stretches that repeat next to each other become a repeated group. Pages of a host with the same set of block tags and names
are one structure, and every page takes part in its structure's wrapper: equal outlines are merged in the task that reads them, then
wrappers are aligned with each other in a tree: equal tags and texts match, unequal texts become a text slot, and a mismatch of
tags becomes an optional group. The wrapper is reduced to one element: the smallest that holds all text which changes from page to page.
In every page of the structure that element is read, without the parts named as furniture; slots and groups are not read one by one.

A structure whose text doesn't change (as of a single page) takes the element of its host's other structures where those agree, and failing that
of all hosts where those agree; a page without such an element is read whole but for the parts named as furniture. Digits in class names and ids
don't count. Null html: empty text. Null url: the host is empty. Repeated rows are read each by itself, an empty table gives an empty result,
and extra columns are ignored.
"""

from __future__ import annotations

import difflib
import hashlib
import html
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import map_batches, stored
from tidebar.session import carry_code

SALTS, LONGEST_REPEAT = 64, 40
#: Items of outlines that a task holds before it sends its wrappers on, salts of the first merging, longest fixed text that is kept as such.
HELD_ITEMS, MERGE_SALTS, FIXED_CHARS = 100_000, 16, 80

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>|[^<]+|<""", re.S | re.I
)
DIGITS = re.compile(r"\d+")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# Elements that never hold an article's text, elements without an end tag, and elements inside a block.
AWAY = frozenset("nav header footer aside form script style noscript template iframe button select option textarea head title svg object canvas menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
AWAY_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|sponsored|promo|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|menu|nav|navbar|navigation|breadcrumbs?|sidebar|widget|"
    r"related|recommended|share|sharing|social|comments?|respond|replies|disqus|header|footer|masthead|login|search)(?:$|[\s_-])", re.I
)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): 'open' and 'close' with the tag and its class names, 'text' with the raw text."""
    for match in TOKEN.finditer(page):
        name = match[3]
        if name:
            if match[2]:
                yield "close", name.lower(), ""
            else:
                names = " ".join(x for found in NAMED.findall(match[4]) for x in found if x) if match[4] else ""
                yield "open", name.lower(), names
        elif not match[0].startswith("<") or match[0] == "<":
            if match[0].strip():
                yield "text", "", match[0]


def signature(name: str, names: str) -> str:
    return f"{name}.{DIGITS.sub('0', names)}"


def outline(page: str) -> list[dict]:
    """Items of the page: key (signature of a start tag, /name, # for text) and text; neighbouring equal blocks of one text are one repeated block."""
    out: list[dict] = []
    away, away_name = 0, ""
    for kind, name, value in tokens(page):
        if away:
            if kind != "text" and name == away_name:
                away += 1 if kind == "open" else -1
            continue
        if kind == "text":
            if out and out[-1]["key"] == "#":
                out[-1]["text"] += value
                continue
            out.append({"key": "#", "text": value, "optional": False, "repeat": False})
        elif name in INLINE or name in VOID:
            continue
        elif kind == "open" and _is_away(name, value):
            away, away_name = 1, name
            continue
        else:
            out.append({"key": signature(name, value) if kind == "open" else f"/{name}", "text": "", "optional": False, "repeat": False})
        # The block that ends here, with or without an end tag, if the one before it has the same keys.
        for size in (3, 2):
            at = len(out) - size - (size == 2)
            if at >= size and out[at + 1]["key"] == "#" and out[at]["key"][0] not in "#/" and (size == 2 or out[-1]["key"][0] == "/") and [x["key"] for x in out[at : at + size]] == [x["key"] for x in out[at - size : at]]:
                for x, y in zip(out[at - size : at], out[at : at + size]):
                    x.update(text=x["text"] + "\0" + y["text"] if x["key"] == "#" else "", repeat=True)
                del out[at : at + size]
                break
    for x in out:
        if len(x["text"]) > FIXED_CHARS:
            x["text"] = "\1" + hashlib.blake2b(x["text"].encode("utf-8", "replace"), digest_size=16).hexdigest()
    return out


def structure_of(items: list[dict]) -> int:
    """The set of start tags with their names, as a hash."""
    tags = "\n".join(sorted({x["key"] for x in items if x["key"][0] not in "#/"}))
    return int.from_bytes(hashlib.blake2b(tags.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def merged(x: dict, y: dict) -> dict:
    """An item for both; the text of a slot is null."""
    return x | {"text": x["text"] if x["text"] == y["text"] else None, "optional": x["optional"] or y["optional"], "repeat": x["repeat"] or y["repeat"]}


def repeated_groups(items: list[dict]) -> list[dict]:
    """Items with neighbouring equal stretches that begin with a tag folded into one repeated stretch, the shortest first."""
    for size in range(1, min(LONGEST_REPEAT, len(items) // 2) + 1):
        keys = [x["key"] for x in items]
        if not any(keys[i] == keys[i + size] and keys[i][0] not in "#/" and keys[i : i + size] == keys[i + size : i + 2 * size] for i in range(len(keys) - 2 * size + 1)):
            continue
        out, i = [], 0
        while i < len(items):
            group = keys[i : i + size]
            times = 1
            while group[0][0] not in "#/" and keys[i + times * size : i + (times + 1) * size] == group:
                times += 1
            for k in range(size if times > 1 else 1):
                again = [items[i + t * size + k]["text"] for t in range(times)]
                out.append(items[i + k] | ({"repeat": True, "text": None if None in again else "\0".join(again)} if times > 1 else {}))
            i += times * size if times > 1 else 1
        items = out
    return items


def align(wrapper: list[dict], other: list[dict]) -> list[dict]:
    """The wrapper that matches both: what only one side has becomes optional, texts that differ share a slot."""
    a, b = [x["key"] for x in wrapper], [x["key"] for x in other]
    out: list[dict] = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [merged(x, y) for x, y in zip(wrapper[i:j], other[k:m])]
        else:
            out += [x | {"optional": True} for x in wrapper[i:j] + other[k:m]]
    return out


def merge(wrappers: list[list[dict]]) -> list[dict]:
    """One wrapper for all, aligned in pairs."""
    while len(wrappers) > 1:
        wrappers = [align(*wrappers[k : k + 2]) if k + 1 < len(wrappers) else wrappers[k] for k in range(0, len(wrappers), 2)]
    return wrappers[0]


def infer(pages: list[str]) -> list[dict]:
    """The wrapper of pages of one structure."""
    return merge([repeated_groups(outline(page)) for page in pages])


def expression(wrapper: list[dict]) -> str:
    """The wrapper as text: <tag> fixed, #SLOT where texts differ, (...)? optional, (...)+ repeated."""
    out = []
    for x in wrapper:
        key = x["key"]
        part = ("#SLOT" if x["text"] is None else "..." if x["text"].startswith("\1") else html.escape(x["text"].replace("\0", " "))) if key == "#" else f"<{key}>"
        out.append(f"({part})+" if x["repeat"] else f"({part})?" if x["optional"] else part)
    return "".join(out)


def main_element(wrapper: list[dict]) -> str | None:
    """Signature of the smallest element that holds all text that changes or is not on every page; empty if only the whole page does, None if no text changes."""
    changing = [i for i, x in enumerate(wrapper) if x["key"] == "#" and (x["text"] is None or x["optional"])]
    open_at: list[tuple[str, str, int]] = []
    spans = []
    for i, x in enumerate(wrapper):
        key = x["key"]
        if key == "#":
            continue
        if key.startswith("/"):
            if key[1:] in [n for n, _, _ in open_at]:
                while open_at:
                    name, full, start = open_at.pop()
                    if name == key[1:]:
                        if not (x["optional"] or wrapper[start]["optional"]):
                            spans.append((start, i, full))
                        break
        else:
            open_at.append((key.partition(".")[0], key, i))
    good = [(b - a, key) for a, b, key in spans if key.partition(".")[0] not in {"p", "li", "html"} and changing and a < changing[0] and changing[-1] < b]
    return min(good)[1] if good else "" if changing else None


def _is_away(name: str, names: str) -> bool:
    return name in AWAY or bool(names and AWAY_NAMES.search(names))


def main_text(page: str, element: str | None) -> str | None:
    """Blocks of text inside the elements of that signature (None: of the whole page); None if the page has no such element."""
    blocks, words, seen = [], [], element is None
    inside, away, away_name = (1 if element is None else 0), 0, ""
    main = (element or "").partition(".")[0]
    for kind, name, value in tokens(page):
        if away:
            if kind != "text" and name == away_name:
                away += 1 if kind == "open" else -1
            continue
        if kind == "open":
            if inside and name not in VOID and _is_away(name, value):
                away, away_name = 1, name
            elif element is not None and name == main and (inside or signature(name, value) == element):
                inside, seen = inside + 1, True
        elif kind == "close" and element is not None and name == main and inside:
            inside -= 1
        if kind == "text":
            if inside:
                words.append(value)
        elif name == "br":
            words.append(" ")
        elif name not in INLINE and words:
            blocks.append("".join(words))
            words = []
    blocks.append("".join(words))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b) if seen else None


WRAPPERS = "host string, structure long, wrapper string"


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """host, structure and wrapper (JSON) of the pages (host, html) of a task; equal outlines are merged at once."""
    held: dict[tuple, dict[tuple, list[dict]]] = {}
    size = 0

    def sent() -> pa.RecordBatch:
        rows = [(*key, json.dumps(merge([repeated_groups(items) for _, items in sorted(same.items())]))) for key, same in held.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string()))], ["host", "structure", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            items = outline(page)
            same = held.setdefault((host, structure_of(items)), {})
            keys = tuple(x["key"] for x in items)
            if keys in same:
                same[keys] = [merged(x, y) for x, y in zip(same[keys], items)]
            else:
                same[keys] = items
                size += len(items) + 1
            if size > HELD_ITEMS:
                yield sent()
                held.clear()
                size = 0
    if held:
        yield sent()


def _merge_group(group: pa.Table) -> pa.Table:
    whole = merge([json.loads(w) for w in sorted(group["wrapper"].to_pylist())]) if len(group) > 1 else json.loads(group["wrapper"][0].as_py())
    return pa.table({"host": group["host"].slice(0, 1), "structure": group["structure"].slice(0, 1), "wrapper": pa.array([json.dumps(repeated_groups(whole))])})


def _rule(group: pa.Table) -> pa.Table:
    found = _merge_group(group)
    wrapper = json.loads(found["wrapper"][0].as_py())
    element = main_element(wrapper)
    row = {"element": pa.array([element], pa.string()), "wrapper": pa.array([None if element is None else expression(wrapper)], pa.string())}
    return pa.table({"host": found["host"], "structure": found["structure"], **row})


def wrappers(pages: DataFrame) -> DataFrame:
    """host, structure, element, wrapper (as an expression) of every structure; element is null where no text changes, empty where only the whole page holds all that does."""
    carry_code()
    partial = map_batches(pages.select("host", "html"), _partial, WRAPPERS)
    partial = partial.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(MERGE_SALTS))).groupBy("host", "structure", "salt").applyInArrow(_merge_group, WRAPPERS)
    return partial.groupBy("host", "structure").applyInArrow(_rule, "host string, structure long, element string, wrapper string")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    rules = stored(wrappers(rows), "wrappers")
    agreed = F.when(F.min("element") == F.max("element"), F.min("element"))
    common = rules.agg(agreed).first()[0]
    own = rules.groupBy("host").agg(agreed.alias("own"))
    rules = rules.join(own, "host").select("host", "structure", F.coalesce("element", "own").alias("element")).where("element IS NOT NULL")
    # A host may have a third of the pages: its rule is joined under several keys.
    salted = rules.select("host", "structure", "element", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

    def with_structure(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.slice(at, 100)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([structure_of(outline(page)) for page in part.column(2).to_pylist()], pa.int64())], [*part.schema.names, "structure"])

    rows = map_batches(rows, with_structure, "page_id long, url string, html string, host string, structure long")
    ruled = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", F.length("html")), F.lit(SALTS)).cast("int")).join(salted, ["host", "structure", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.slice(at, 100)
                texts = []
                for page, element in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    element = common if element is None else element
                    text = main_text(page, element) if element else None
                    texts.append(main_text(page, None) if text is None else text)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(ruled.select("page_id", "url", "html", "element"), run, "page_id long, url string, text string, n_chars long")
