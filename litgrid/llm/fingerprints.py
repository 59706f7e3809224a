"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_in, id_out, lean, prepared

#: One of so many words ends a leaf, chosen by its hash, so that edits move no other border; and the most characters of a leaf.
WORDS, MOST = 6, 320
#: One of so many paragraphs ends a section, chosen by its hash, so that edits move no other border.
SECTION = 6
#: Each character of scripts without spaces is a word.
_BARE = "\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff"
_WORD = re.compile(rf"\s*(?:[{_BARE}]|[^\s{_BARE}]+)\s*|\s+")


#: Bytes of a node's hash, and of the root's.
NODE, ROOT = 6, 16


def _hash(data: bytes, size: int) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def leaves(paragraph: str) -> list[str]:
    """The paragraph's parts, which together are the paragraph: a few words each, and long words in pieces."""
    found, start, at = [], 0, 0
    for word in _WORD.findall(paragraph):
        at += len(word)
        if zlib.crc32(word.strip().encode("utf-8", "surrogatepass")) % WORDS == 0:
            found.append(paragraph[start:at])
            start = at
    if start < at:
        found.append(paragraph[start:at])
    return [p[i : i + MOST] for p in found for i in range(0, len(p), MOST)]


def tree(text: str) -> tuple[str, list]:
    """Root hash, and sections (hash, characters, paragraphs), of paragraphs (hash, characters, leaves), of leaves (hash,
    characters).

    A leaf's hash is over its text, every other node's over its children's hashes, so equal roots mean equal texts and
    equal nodes equal parts. Paragraphs are lines with their line end. A section ends with an empty line or a paragraph
    whose hash is drawn.
    """
    sections, section = [], []
    lines = text.split("\n")
    for k, line in enumerate(lines):
        paragraph = line + "\n" * (k + 1 < len(lines))
        if not paragraph:
            continue
        parts = leaves(paragraph)
        hashes = [_hash(p.encode("utf-8", "surrogatepass"), NODE) for p in parts]
        node = _hash(b"".join(hashes), NODE)
        section.append((node.hex(), len(paragraph), [(h.hex(), len(p)) for h, p in zip(hashes, parts, strict=True)]))
        if not line or node[0] % SECTION == 0:
            sections.append(_section(section))
            section = []
    if section:
        sections.append(_section(section))
    return _hash(b"".join(bytes.fromhex(s[0]) for s in sections), ROOT).hex(), sections


def _section(paragraphs: list) -> tuple[str, int, list]:
    return _hash(b"".join(bytes.fromhex(p[0]) for p in paragraphs), NODE).hex(), sum(p[1] for p in paragraphs), paragraphs


def written(root: str, sections: list) -> str:
    """root, then sections after |, each with its hash and, after a colon, its paragraphs parted by commas; a paragraph is its
    hash and, after =, its leaves parted by dots; a leaf is its hash and its length in hexadecimal digits."""
    return root + "".join(f"|{h}:" + ",".join(f"{p}=" + ".".join(f"{x}{n:x}" for x, n in parts) for p, _, parts in own) for h, _, own in sections)


def parsed(fingerprint: str) -> tuple[str, list]:
    root, *rest = fingerprint.split("|")
    sections = []
    for s in rest:
        h, own = s.split(":")
        paragraphs = []
        for p in own.split(","):
            node, parts = p.split("=")
            found = [(x[: 2 * NODE], int(x[2 * NODE :], 16)) for x in parts.split(".")]
            paragraphs.append((node, sum(n for _, n in found), found))
        sections.append((h, sum(p[1] for p in paragraphs), paragraphs))
    return root, sections


def _alike(a: tuple, b: tuple) -> float:
    """Equal nodes are counted whole, sections first; only the children of the others are compared further."""
    if a[0] == b[0]:
        return 1.0
    x, y, same = a[1], b[1], 0
    most = sum(n[1] for n in x) + sum(n[1] for n in y)
    for _ in range(3):
        both = Counter(n[0] for n in x) & Counter(n[0] for n in y)
        rest = []
        for nodes, count in ((x, True), (y, False)):
            left, own = Counter(both), []
            for n in nodes:
                if left[n[0]] > 0:
                    left[n[0]] -= 1
                    same += n[1] * count
                else:
                    own += n[2] if len(n) == 3 else []
            rest.append(own)
        x, y = rest
    return 2 * same / most if most else 0.0


def likeness(a: str, b: str) -> float:
    """Share of the characters of both texts that stand in equal nodes of the trees; 1 if the roots are equal."""
    return _alike(parsed(a), parsed(b))


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Spans of the second text in leaves that the first lacks, found by going down differing branches only."""
    (root_a, x), (root_b, y) = parsed(a), parsed(b)
    if root_a == root_b:
        return []
    known = {s[0] for s in x}, {p[0] for s in x for p in s[2]}, {leaf[0] for s in x for p in s[2] for leaf in p[2]}
    found: list[tuple[int, int]] = []

    def down(nodes: list, at: int, level: int) -> None:
        for n in nodes:
            if n[0] not in known[level]:
                if level < 2:
                    down(n[2], at, level + 1)
                elif found and found[-1][1] == at:
                    found[-1] = (found[-1][0], at + n[1])
                else:
                    found.append((at, at + n[1]))
            at += n[1]

    down(y, 0, 0)
    return found


def _row(doc_id: int, text: str, own: tuple, after: str, next_tree: tuple) -> tuple:
    q = len(text) // 4
    edited = text[: len(text) - q] + after[:q]
    made = tree(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(*own), written(*made), _alike(own, made), _alike(own, next_tree))


def compare(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next document's.

    The edited text has the next document's start in place of its last quarter. Documents are dealt into ranges of ids,
    with borders drawn once; each task goes through its ranges in order. A light pass takes each range's first and last
    text, by which the last row of a range meets the first of the next: what a range holds depends on the borders alone.

    Null texts are empty. A null id comes first; equal ids are ordered by their text's hash. The last document's next is
    the first; a single document is its own next. Texts of any length are parsed whole. An empty table gives no rows; other
    columns are not used.
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    prepared(spark)
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    @lean
    def walk(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for x in rows:
            out = []
            for i, text, at in zip(x["doc_id"].tolist(), x["text"], x["range"].tolist(), strict=True):
                own = tree(text)
                if last and last[0] == at:
                    out.append(_row(*last[1:], text, own))
                last = (at, i, text, own)
            yield pd.DataFrame(out, columns=columns)

    @lean
    def finish(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in rows:
            yield pd.DataFrame([_row(i, a, tree(a), b, tree(b)) for i, a, b in zip(x["doc_id"].tolist(), x["text"], x["after"], strict=True)], columns=columns)

    tie, n = F.xxhash64("text"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(id_in(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    borders = plain.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10 * max(1000, n))).first()[0] or []
    ranged = plain.withColumn("range", _range(F.col("doc_id"), tie, borders))
    ordered = ranged.repartitionByRange(n, "range").sortWithinPartitions("range", "doc_id", tie)
    place = F.struct("doc_id", tie.alias("tie"))
    ends = ranged.groupBy("range").agg(F.min_by("text", place).alias("first"), F.max_by(F.struct("doc_id", "text"), place).alias("last"))
    w = Window.orderBy("range")  # two texts of each range
    pairs = ends.select("range", "first", "last.*").withColumn("after", F.coalesce(F.lead("first").over(w), F.first("first").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    found = ordered.mapInPandas(walk, schema).union(pairs.select("doc_id", "text", "after").mapInPandas(finish, schema))
    return found.withColumn("doc_id", id_out())


def _range(doc_id: Column, tie: Column, borders: list[int]) -> Column:
    """The number of borders below the id; an id that is several borders has as many ranges, by the tie."""
    all_of = F.lit(borders) if borders else F.array().cast("array<bigint>")
    below, upto = F.size(F.filter(all_of, lambda b: b < doc_id)), F.size(F.filter(all_of, lambda b: b <= doc_id))
    return (below + F.floor((upto - below + 1) * ((tie / 2.0**64) + 0.5) * (1 - 2.0**-40))).cast("int")
