"""Operator 5: main text by template deduction with equivalence classes.

A page is a sequence of tokens: its elements, told apart by their path, and
their own texts. Over the pages of one host

1. tokens with the same occurrence vector (how often each page has them) form
   an equivalence class; frequent and large classes come from the template.
   Vectors are compared by digests that are summed over pages, so a host's
   pages never meet in one place;
2. a class is valid if every page has its tokens in one order, repeated as
   often as the vector says, inside an occurrence of one parent class. Valid
   classes nest: the template are those whose parents lead up to a class
   without one, and what hangs on a class that isn't valid is no part of it;
3. what lies between the template's tokens are slots, told by the innermost
   element of the template around them; slots() gives the text of them all.
   Texts that are tokens of the template themselves, on nearly every page of
   the host, are its static text and belong to no slot;
4. the main slots are those below one element of the template, found by what
   slots hold and not by names: of the elements with over HALF of the host's
   text in slots, the outermost article, else main, else the deepest that
   has MOST of it;
5. if that is no article and holds little but containers, these are of kinds,
   told by their path and what they begin with. Counts over the host's pages
   judge kinds: those with little text, or mostly links, are left out.

A page's text are the blocks of its main slots. Within them menus, adverts,
forms, scripts and comments are left out by tag, role, class or id, since
statistics can't tell a reader's comment from an author's text. A page whose
host has no template, or that doesn't have the main element, goes by its own
tree alone: article, main, else the body. A page of which only static text is
left keeps that.

Null or empty html gives the empty text. Pages without a host share the host
''. Repeated rows count as pages of their own; null page_ids are kept; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, html_text

#: A template needs so many pages; its tokens are on this share of them at least; its classes have so many tokens.
MIN_PAGES, MIN_SUPPORT, MIN_TOKENS = 3, 0.5, 2
#: Shares of a host's text that the main slots hold: within an article or main, and elsewhere.
HALF, MOST = 0.5, 0.95
#: Static text is on this share of a host's pages, of which there are so many.
STATIC_SHARE, STATIC_PAGES = 0.9, 5
#: A kind of container is left out if it has less than this share of the text of the largest kind, or a larger share of links than of other text.
KIND_SHARE = 0.25
CONTAINERS = frozenset(("div", "section", "center", "td", "ul", "ol"))
#: Templates of so many tokens in all are sent to every task; more are joined by host.
BROADCAST_TOKENS = 1_000_000
SALTS = 16


def hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), host.alias("host"))


def occurrences(pages: DataFrame) -> DataFrame:
    """host, page (a number for the row), token, n: a row per page and token."""
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("token", pa.int64()), ("n", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for host, page, text in zip(batch.column("host").to_pylist(), batch.column("page").to_pylist(), batch.column("html"), strict=True):
                for token, n in Counter(html_text.tokens(html_text.parse(text.as_py()))).items():
                    yield host, page, token, n

    numbered = pages.select("host", F.xxhash64("page_id", "url", F.monotonically_increasing_id()).alias("page"), "html")
    return numbered.transform(common.map_batches, lambda b: common.rows_to_batches(rows(b), schema, 16384), "host string, page long, token long, n long")


def classes(pages: DataFrame) -> DataFrame:
    """host, class_no, tokens: the frequent and large equivalence classes of each host with enough pages."""
    digest = F.xxhash64("page", "n")
    vectors = occurrences(pages).groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.sum("n").alias("total"), F.bit_xor(digest).alias("xor"), F.sum(F.pmod(digest, F.lit(1 << 31))).alias("sum")
    )
    sizes = pages.groupBy("host").agg(F.count("*").alias("host_pages")).where(F.col("host_pages") >= MIN_PAGES)
    frequent = vectors.where(F.col("pages") >= MIN_PAGES).join(sizes, "host").where(F.col("pages") >= MIN_SUPPORT * F.col("host_pages"))
    # frequent tokens of a host are at most the mean page's tokens / MIN_SUPPORT
    found = frequent.groupBy("host", "host_pages", "pages", "total", "xor", "sum").agg(F.array_sort(F.collect_list("token")).alias("tokens")).where(F.size("tokens") >= MIN_TOKENS)
    every = (F.col("host_pages") >= STATIC_PAGES) & (F.col("pages") >= STATIC_SHARE * F.col("host_pages"))
    return found.select("host", F.xxhash64("pages", "total", "xor", "sum").alias("class_no"), (F.col("total") == F.col("pages")).alias("once"), every.alias("static"), "tokens")


def with_classes(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Each page with `classes`: those of its host, or null. A host's pages are spread over SALTS keys if templates are too many to send."""
    per_host = found.groupBy("host").agg(F.collect_list(F.struct(*[c for c in found.columns if c != "host"])).alias("classes"))
    tokens = found.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    if tokens <= BROADCAST_TOKENS:
        return pages.join(F.broadcast(per_host), "host", "left")
    salted = per_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def order_of(sequence: list[int], size: int) -> tuple[int, ...] | None:
    """The order of a class's tokens if the sequence is that order again and again."""
    first = tuple(sequence[:size])
    return first if len(set(first)) == size and sequence == list(first) * (len(sequence) // size) else None


def nested(pages: DataFrame, found: DataFrame) -> DataFrame:
    """host, class_no, tokens in page order, parent (class or null), static, slots (token, tag, depth, chars): the valid classes.

    slots are of elements that a page has once; chars: text of all pages in and below the element that isn't static; kinds (kind, chars, links): of its children.
    """
    schema = pa.schema([("host", pa.string()), ("class_no", pa.int64()), ("order", pa.string()), ("parent", pa.int64()), ("token", pa.int64()), ("tag", pa.string()), ("depth", pa.int64()), ("kind", pa.int64()), ("chars", pa.int64()), ("links", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for host, known, text in zip(batch.column("host").to_pylist(), batch.column("classes").to_pylist(), batch.column("html"), strict=True):
                if not known:
                    continue
                root = html_text.parse(text.as_py())
                class_of = {t: c["class_no"] for c in known for t in c["tokens"]}
                size = {c["class_no"]: len(c["tokens"]) for c in known}
                once = {t for c in known if c["once"] for t in c["tokens"]}
                static = {t for c in known if c["static"] for t in c["tokens"] if t & 1}
                sequence: dict[int, list[int]] = {}
                parents: dict[int, set[int | None]] = {}
                for token in html_text.tokens(root):
                    if token in class_of:
                        sequence.setdefault(class_of[token], []).append(token)
                # of the nearest element of a class, itself or around it: its class, and the nearest other class around that
                near: dict[int, tuple[int, int | None] | None] = {}
                for e in html_text.elements(root):
                    own, around = class_of.get(e.token), near[id(e.parent)] if e.parent is not None else None
                    if own is None:
                        near[id(e)] = around
                        continue
                    above = None if around is None else around[0] if around[0] != own else around[1]
                    near[id(e)] = own, above
                    parents.setdefault(own, set()).add(above)
                for number, tokens in sequence.items():
                    order, above = order_of(tokens, size[number]), parents.get(number, {None})
                    # the class's outermost elements tell its parent; deeper ones lie in classes nested in it
                    yield host, number, "" if order is None else ",".join(map(str, order)), min(above, key=lambda p: (p is not None, p or 0)), None, None, None, None, 0, 0
                kinds: dict[tuple[int, int], list[int]] = {}
                around: dict[int, tuple[str, int]] = {}
                for e, depth, chars, links in html_text.slot_chars(root, static):
                    if e.token in once:
                        yield host, class_of[e.token], None, None, e.token, e.tag, depth, None, chars, links
                    if chars and e.parent is not None and e.parent.token in once:
                        around[e.parent.token] = e.parent.tag, depth - 1
                        sums = kinds.setdefault((e.parent.token, kind_of(e)), [0, 0])
                        sums[0] += chars
                        sums[1] += links
                for (token, kind), (chars, links) in kinds.items():
                    yield host, class_of[token], None, None, token, *around[token], kind, chars, links

    fields = "host string, class_no long, `order` string, parent long, token long, tag string, depth long, kind long, chars long, links long"
    seen = common.stored(with_classes(pages, found).select("host", "classes", "html").transform(common.map_batches, lambda b: common.rows_to_batches(rows(b), schema, 16384), fields), "template-orders")
    valid = (
        seen.where("order is not null")
        .groupBy("host", "class_no")
        .agg(F.min("order").alias("order"), F.max("order").alias("last"), F.min("parent").alias("parent"), F.max("parent").alias("other"))
        .where(F.col("order").eqNullSafe(F.col("last")) & (F.col("order") != "") & F.col("parent").eqNullSafe(F.col("other")))
    )
    each = seen.where("token is not null").groupBy("host", "class_no", "token", "tag", "depth", "kind").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    kinds = F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "chars", "links"))).alias("kinds")
    each = each.groupBy("host", "class_no", "token", "tag", "depth").agg(F.sum(F.when(F.col("kind").isNull(), F.col("chars"))).alias("chars"), kinds)
    slots = each.groupBy("host", "class_no").agg(F.collect_list(F.struct("token", "tag", "depth", "chars", "kinds")).alias("slots"))
    every = found.select("host", "class_no", "static")
    return valid.join(slots, ["host", "class_no"], "left").join(every, ["host", "class_no"]).select("host", "class_no", F.split("order", ",").cast("array<bigint>").alias("tokens"), "parent", "static", "slots")


def kind_of(e: html_text.Element) -> int:
    """The kind of a container: its path, and the tag of what it begins with; 0 for other elements."""
    if e.tag not in CONTAINERS:
        return 0
    first = next((c.tag if not isinstance(c, str) else "#" for c in e.children if not isinstance(c, str) or c.strip()), "")
    return html_text.token_of(f"kind {first}", e.token)


def in_template(valid: DataFrame) -> DataFrame:
    """The valid classes whose parents lead up to a class without a parent; nesting is as deep as pages' elements, so it's followed down level by level."""
    level, kept = valid.where("parent is null"), None
    while True:
        level = common.stored(level, "template-level")
        kept = level if kept is None else kept.unionByName(level)
        if not level.limit(1).count():
            return kept
        # a class has one parent, so no class comes twice
        level = valid.join(level.select("host", F.col("class_no").alias("parent")), ["host", "parent"], "left_semi").select(valid.columns)


def main_chars(root: html_text.Element) -> list[tuple[html_text.Element, int]]:
    """Every element that isn't within other matter, in page order, and the characters of its text and that of elements below."""
    found: list[list] = []

    def visit(e: html_text.Element, up: list | None) -> None:
        own = [e, len(html_text.own_text(e)), up]
        found.append(own)
        todo.extend((c, own) for c in reversed(e.children) if not isinstance(c, str) and not c.is_other())

    todo: list[tuple[html_text.Element, list | None]] = [(root, None)]
    while todo:
        visit(*todo.pop())
    for _, chars, up in reversed(found):
        if up is not None:
            up[1] += chars
    return [(e, chars) for e, chars, _ in found]


def main_slots(template: DataFrame) -> DataFrame:
    """host, main (the element whose slots are the main ones, or null), static (tokens of static text) and kinds (of main's containers, those that are kept; empty: all) of each template."""
    each = template.select("host", F.explode("slots").alias("s")).select("host", "s.*").where("chars > 0")
    most = each.groupBy("host").agg(F.max("chars").alias("most"))
    # elements with over half of the text lie in one another
    nested = each.join(most, "host").where(F.col("chars") > HALF * F.col("most"))
    outer = lambda tag: F.min_by("token", F.when(F.col("tag") == tag, F.col("depth")))
    deepest = F.max_by("token", F.when(F.col("chars") >= MOST * F.col("most"), F.col("depth")))
    main = nested.groupBy("host").agg(F.coalesce(outer("article"), outer("main"), deepest).alias("main"))
    static = template.where("static").select("host", F.explode("tokens").alias("token")).where(F.col("token").bitwiseAND(F.lit(1)) == 1).groupBy("host").agg(F.array_sort(F.collect_set("token")).alias("static"))
    # kinds of an element with little but containers
    own = each.join(main, "host").where("token = main").select("host", "chars", "kinds")
    loose = F.aggregate("kinds", F.lit(0).cast("bigint"), lambda n, k: n + F.when(k["kind"] == 0, k["chars"]).otherwise(0))
    plain = F.filter("kinds", lambda k: (k["kind"] != 0) & (2 * k["links"] <= k["chars"]))
    largest = F.array_max(F.transform(plain, lambda k: k["chars"]))
    rest = F.transform(F.filter(plain, lambda k: k["chars"] >= KIND_SHARE * largest), lambda k: k["kind"])
    kinds = own.select("host", F.when(loose <= (1 - MOST) * F.col("chars"), rest).alias("kinds"))
    none = F.array().cast("array<bigint>")
    return main.join(static, "host", "full").join(kinds, "host", "left").select("host", "main", F.coalesce("static", none).alias("tokens"), F.coalesce("kinds", none).alias("kinds"))


def deepest_article(root: html_text.Element) -> html_text.Element:
    """The page's own main element: its largest article or main that isn't other matter nor within an article, else the whole."""
    found = [(e, chars) for e, chars in main_chars(root) if e.tag in ("main", "article") and not e.within("article")]
    return max(found, key=lambda p: (p[1], p[0].tag == "article"), default=(root, 0))[0]


def slot_of(root: html_text.Element, main: int | None) -> html_text.Element | None:
    """The page's element with the main slots, unless it's other matter."""
    found = next((e for e in html_text.elements(root) if e.token == main), None) if main is not None else None
    up = found
    while up is not None:
        if up.is_other():
            return None
        up = up.parent
    return found


def text_of(page: str, main: int | None, static: frozenset[int] = frozenset(), kinds: frozenset[int] = frozenset()) -> str:
    root = html_text.parse(page)
    slot = slot_of(root, main)
    top = slot if slot is not None and slot.tag in ("article", "main") else deepest_article(root if slot is None else slot)
    if top.tag in ("article", "main"):  # what an author repeats on every page is the author's
        return "\n\n".join(html_text.blocks(top))
    kept = [c for c in top.children if not isinstance(c, str) and kind_of(c) in kinds and not c.is_other()] if top is slot else []
    if kept and (found := [text for c in kept for text in html_text.blocks(c, static)]):
        return "\n\n".join(found)
    return "\n\n".join(list(html_text.blocks(top, static)) or html_text.blocks(top))


EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
SLOTS = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("slot", pa.int64()), ("place", pa.int64()), ("text", pa.string())])


def templates_of(own: DataFrame) -> DataFrame:
    """The classes of each host's template, stored. own: hosted() pages."""
    found = common.stored(classes(own), "template-classes")
    return common.stored(in_template(common.stored(nested(own, found), "template-valid")), "templates")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    own = hosted(pages)
    slots = common.stored(main_slots(templates_of(own)), "template-slots")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for page_id, url, known, page in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("classes").to_pylist(), batch.column("html"), strict=True):
                text = text_of(page.as_py(), known[0]["main"], frozenset(known[0]["tokens"]), frozenset(known[0]["kinds"])) if known else text_of(page.as_py(), None)
                yield page_id, url, text, len(text)

    return with_classes(own, slots).select("page_id", "url", "classes", "html").transform(common.map_batches, lambda b: common.rows_to_batches(rows(b), EXTRACTED), "page_id long, url string, text string, n_chars long")


def slots(pages: DataFrame) -> DataFrame:
    """page_id, host, slot, place and text: what is in every slot of every page whose host has a template, in page order. slot: the token of the innermost element of the template."""
    own = hosted(pages)
    template = templates_of(own).select("host", "class_no", "static", "tokens")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for page_id, host, known, page in zip(batch.column("page_id").to_pylist(), batch.column("host").to_pylist(), batch.column("classes").to_pylist(), batch.column("html"), strict=True):
                if known:
                    static = {t for c in known if c["static"] for t in c["tokens"] if t & 1}
                    found = remaining(html_text.parse(page.as_py()), {t for c in known for t in c["tokens"]}, static)
                    yield from ((page_id, host, slot, k, text) for k, (slot, text) in enumerate(found))

    fields = "page_id long, host string, slot long, place long, text string"
    return with_classes(own, template).select("page_id", "host", "classes", "html").transform(common.map_batches, lambda b: common.rows_to_batches(rows(b), SLOTS), fields)


def remaining(root: html_text.Element, template: set[int], static: set[int]) -> Iterator[tuple[int, str]]:
    """(slot, text) of what lies between a template's tokens on a page."""
    todo: list[tuple[html_text.Element, int]] = [(root, root.token)]
    while todo:
        e, slot = todo.pop()
        slot = e.token if e.token in template else slot
        if (text := html_text.own_text(e)) and html_text.text_token(e, text) not in static:
            yield slot, text
        todo += [(c, slot) for c in reversed(e.children) if not isinstance(c, str) and (c.tag not in html_text.OTHER_TAGS or c.tag in html_text.SEEN)]
