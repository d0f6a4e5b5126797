"""Extraction from stored pages, on the nodes that ``pagetree`` reads them into."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from hearthlens.functions import pagetree as tree
from hearthlens.functions.codec import decrypt_text
from hearthlens.functions.text import join_pieces


def read_pages(df: DataFrame, html: str, keys: list[str], out: str = "nodes") -> DataFrame:
    """The keys and the nodes of every page, read once for all that is taken from them. The column functions below
    take this column."""
    return df.select(*[F.col(k) for k in keys], tree.nodes(F.col(html)).alias(out))


def attribute_of_class(page: Column, css_class: str, attribute: str) -> Column:
    """An attribute of the first element that carries the class."""
    return tree.attribute(F.get(tree.with_class(page, css_class), F.lit(0)), attribute)


def anchors(page: Column) -> Column:
    """All links in page order as an array of (text, href): the text without its tags, anchors without an address
    have a null one. A link that nobody closed ends with the element around it or at the next link."""
    return F.transform(tree.with_tag(page, "a"), lambda a: F.struct(tree.text_of(page, a).alias("name"), tree.attribute(a, "href").alias("href")))


def _links(page: tree._Page) -> Iterator[tuple]:
    """(pos, name, href) of the links with an address, counted among all links."""
    for pos, node in enumerate([i for i, tag in enumerate(page.tag) if tag == "a"]):
        href = dict(page.attributes[node]).get("href")
        if href is not None:
            yield pos, tree.text_inside(page, node), href


def page_links(df: DataFrame, html: str, keys: list[str]) -> DataFrame:
    """One row per link of a page with its position: what ``anchors`` gives, taken while a page is read."""
    return tree.taken(df, html, keys, _links, "pos int, name string, href string")


def matching_anchors(page: Column, conditions: dict[str, str]) -> Column:
    """Addresses of the anchors whose attributes all match the given patterns."""
    def keep(a: Column) -> Column:
        result = F.lit(True)
        for name, pattern in conditions.items():
            result = result & F.coalesce(tree.attribute(a, name).rlike(pattern), F.lit(False))
        return result

    return F.transform(F.filter(tree.with_tag(page, "a"), keep), lambda a: tree.attribute(a, "href"))


def image_sources(page: Column, scheme: str = "https:") -> Column:
    """The source of every image, with the scheme put in front."""
    sources = F.transform(tree.with_tag(page, "img"), lambda image: tree.attribute(image, "src"))
    return F.transform(F.filter(sources, lambda src: src.isNotNull()), lambda src: F.concat(F.lit(scheme), src))


# Fixed value: where an article page keeps the encrypted address of an image.
IMAGE_ADDRESS = "data-src"


def article_fragments(df: DataFrame, html: str, keys: list[str], key: Column | str) -> DataFrame:
    """Paragraph texts and decrypted image addresses of an article in reading order.

    An image whose address does not decrypt is left out, and so is an empty paragraph.
    """
    page = F.col("nodes")
    pieces = F.filter(page, lambda n: (n["tag"] == "p") | tree.attribute(n, IMAGE_ADDRESS).isNotNull())
    parts = F.transform(pieces, lambda n: F.struct(
        F.when(n["tag"] == "p", F.nullif(tree.text_of(page, n), F.lit(""))).alias("text"), tree.attribute(n, IMAGE_ADDRESS).alias("address")))
    rows = read_pages(df, html, keys).select(*keys, F.posexplode(parts).alias("pos", "piece"))
    is_image = F.col("piece.address").isNotNull()
    return rows.select(
        *keys, "pos",
        F.when(is_image, F.lit("image")).otherwise("text").alias("kind"),
        F.when(is_image, decrypt_text(F.col("piece.address"), key)).otherwise(F.col("piece.text")).alias("content"),
    ).where(F.col("content").isNotNull())


# Fixed value: the class of a list of cards; those of the fields are named in ``_cards``.
CARD_LIST = "sellListContent"


def _cards(page: tree._Page) -> Iterator[tuple]:
    """The six fields of each item of the card lists of a page, the position in pieces. Lists inside an item belong to it."""
    pos = 0
    for ul in [i for i, tag in enumerate(page.tag) if tag == "ul" and CARD_LIST in tree.classes_of(page, i)]:
        for li in range(ul + 1, page.last[ul] + 1):
            if page.tag[li] != "li" or page.parent[li] != ul:
                continue
            found: dict[str, int] = {}
            for node in range(li, page.last[li] + 1):
                for name in tree.classes_of(page, node):
                    found.setdefault(name, node)

            def within(name: str, tag: str) -> list[str]:
                return tree.texts_within(page, found[name], tag) if name in found else []

            def own(name: str) -> list[str]:
                return tree.texts_of(page, found[name]) if name in found else []

            first = [next(iter(texts), None) for texts in (within("title", "a"), own("houseInfo"), own("followInfo"), within("totalPrice", "span"), within("unitPrice", "span"))]
            yield pos, first[0], within("positionInfo", "a"), *first[1:]
            pos += 1


def listing_cards(df: DataFrame, html: str, keys: list[str]) -> DataFrame:
    """One row of six text fields per card of a listing page; a missing field is null, except the
    position, whose pieces are joined and may be none. The first element of a class counts."""
    pages = df.where(F.contains(F.col(html), F.lit(CARD_LIST)))
    cards = tree.taken(pages, html, keys, _cards, "pos int, title string, position array<string>, house_info string, follow_info string, total_price string, unit_price string")
    return cards.withColumn("position", join_pieces(F.col("position"), "-"))
