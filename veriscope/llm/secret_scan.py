"""Secret scans: patterns, and zstandard novelty with primed dictionaries.

Three patterns are reported wherever they match.  Beside them, strings that stand near a
sensitive word are compressed together with what surrounds them, by a compressor primed with
a dictionary of identifiers: the bytes that the string adds to its surroundings are its
novelty.  A string known from the dictionary or the surrounding code adds next to nothing; a
random one adds as many bytes as it has characters, and is reported.

A run of encoded characters is split at ``=``, so that the name in ``name=value`` is context
of the value; if a value is not novel as a whole, it is looked at between its name and path
parts.  What a pattern covers is left out, and the rest of the run is measured.  Adjoining
encoded lines (a private key's body) share their context and are measured together.

Cases: a null or empty text has no findings; texts are scanned whole; repeated rows are
scanned alike; further columns stay, a column named like the findings is replaced; an empty
table stays empty.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope.llm.texts import has_columns

KINDS = ("assign", "access", "hex", "novel")
# The patterns, and how long a match must be.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
# A long run of hexadecimal digits is found faster by its length; runs are the same.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")

SHORTEST_NOVEL = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"passw|passphrase|secret|token|api.?key|credential|auth|bearer|private.?key|access.?key|signature",
                       re.ASCII | re.IGNORECASE)
# A run without the "=" between names and values; padding stays with the last one.
PIECE = re.compile(r"[^=]+(?:=+\Z)?")
# Parts of names and paths: words in one case or capitalised, with a short number.
PART = re.compile(r"[^/_-]+")
# No run of letters is tried in two ways, so that a match takes time linear in the text.
NAME = re.compile(r"(?=[A-Za-z])(?:[A-Z]*[a-z]{2,}+)*+(?:[A-Z]{2,}+)?[0-9]{0,3}")
# What stands between two lines, or two dotted parts, of an encoded text; its last, short line.
JOINT = re.compile(r"""\.|[\s"',;#>|*+]*[\n\\][\s"',;#>|*+\\]*""")
LAST_LINE = re.compile(
    r"""[\s"',;#>|*+]{0,8}[\n\\][\s"',;#>|*+\\]{0,23}([A-Za-z0-9/_][A-Za-z0-9+/_=-]{0,14})(?=[\x20\t"',;]*(?:[\r\n\\]|\Z))""")
JOINT_CHARS, WRAPPED_CHARS = 24, 40
CONTEXT_CHARS = 48
SURROUNDING_CHARS = 256
NOVELTY = 0.75
FINDINGS = "array<struct<kind:string,start:int,end:int,novelty:double>>"

# Words that identifiers in code are made of.
IDENTIFIER_PARTS = (
    "access account action address admin api application array async auth authorization backend base bearer boolean "
    "bucket buffer build byte cache callback certificate channel character check class client cluster code column "
    "command commit component config configuration connection constant container content context controller cookie "
    "count create credential cursor data database date default delete dependency description destination device "
    "directory document domain download element email enable encode encoding encryption endpoint entry environment "
    "error event exception execute expiration export expression extension factory feature field file filter folder "
    "format function gateway generate global group handle handler hash header hidden history host identifier image "
    "import index initialize input insert instance integer interface internal iterator json kernel key keyword label "
    "language length library limit link list listener load local location login logger manager mapping memory message "
    "metadata method model module monitor name namespace network node notification number object operation option "
    "order output package page parameter parent parse partition password path pattern payload permission pipeline "
    "placeholder pointer policy port prefix private process processor profile project property protocol provider proxy "
    "public query queue random range read record reference refresh region register release remote replace repository "
    "request resource response result return role root route runtime sample schedule schema scope script search secret "
    "section security select sequence serial server service session setting shared signature size source stack "
    "standard state static status storage stream string structure submit subscription suffix symbol system table tag "
    "target task template tenant test text thread threshold time timeout timestamp title token total trace transaction "
    "transfer type unique update upload user username util validate value variable vector verify version view virtual "
    "volume warning window worker workspace write your example changeme none null true false undefined"
).split()
TRAIL = "x" * 256
VALUES = "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 xxxxxxxxxxxxxxxxxxxxxxxx ----------------"


def identifier_dictionary(parts=IDENTIFIER_PARTS) -> bytes:
    """The dictionary's content: identifiers in the usual ways of writing them."""
    pairs = [*zip(parts, parts[1:]), *zip(parts, parts[2:])]
    written = [*parts, *(a + b.capitalize() for a, b in pairs), *(f"{a}_{b}" for a, b in pairs), *map(str.upper, parts)]
    return (" ".join(written) + " " + VALUES).encode()


class Novelty:
    """Bytes that a string adds to a compressed text."""

    def __init__(self, dictionary: bytes, level: int = 6):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=level)
        self.compressor = zstandard.ZstdCompressor(
            dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: str) -> int:
        # the last bytes are never matched, and what shrinks by a few bytes is stored as it is;
        # without the trail, a string would be credited with the name before it
        return len(self.compressor.compress((text + TRAIL).encode("utf-8", "replace")))

    def __call__(self, text: str, start: int, end: int) -> float:
        """Marginal bytes per character of ``text[start:end]`` against what surrounds it."""
        before, after = text[max(0, start - SURROUNDING_CHARS):start], text[end:end + SURROUNDING_CHARS]
        return (self.size(before + after + text[start:end]) - self.size(before + after)) / (end - start)


@lru_cache(maxsize=2)
def novelty_of(dictionary: bytes) -> Novelty:
    """One per Python worker."""
    return Novelty(dictionary)


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of what the patterns find."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= SHORTEST["access"]]
    return found + [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]


def looks_random(string: str) -> bool:
    """Whether letters and digits are mixed: words and numbers alone are left out."""
    return any(c.isdigit() for c in string) and any(c.isalpha() for c in string)


def encoded_blocks(text: str) -> list[list[tuple[int, int]]]:
    """The candidates, as blocks of adjoining ones."""
    blocks = []
    for match in CANDIDATE.finditer(text):
        start, end = match.span()
        before = blocks[-1][-1][1] if blocks else -1
        if blocks and start - before <= JOINT_CHARS and JOINT.fullmatch(text, before, start):
            blocks[-1].append((start, end))
        else:
            blocks.append([(start, end)])
    return blocks


def merged(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover."""
    starts, ends = [], []
    for start, end, _ in sorted(spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def uncovered(start: int, end: int, covered: tuple[list[int], list[int]]) -> list[tuple[int, int]]:
    """What ``covered`` leaves of a span."""
    starts, ends = covered
    left, at = [], bisect_right(ends, start)
    while at < len(starts) and starts[at] < end:
        if starts[at] > start:
            left.append((start, starts[at]))
        start, at = ends[at], at + 1
    return left + [(start, end)] if start < end else left


def between_names(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """What stands between the name and path parts of a string."""
    found, joined = [], False
    for part in PART.finditer(text, start, end):
        if NAME.fullmatch(part[0]):
            joined = False
        else:
            found.append((found.pop()[0] if joined else part.start(), part.end()))
            joined = True
    return found


def is_name(string: str) -> bool:
    return all(NAME.fullmatch(part) or part.isdigit() for part in PART.findall(string.rstrip("=")))


def novel_spans(text: str, block: list[tuple[int, int]], covered, named: set[int], novelty: Novelty, threshold: float) -> list[tuple[int, int]]:
    """The novel strings of adjoining candidates in a sensitive place; assignments start at ``named``."""
    found = []

    def novel(start: int, end: int) -> bool:
        return looks_random(text[start:end]) and novelty(text, start, end) >= threshold

    wrapped = len(block) > 1 and novelty(text, block[0][0], block[-1][1]) >= threshold
    for start, end in block:
        pieces = [*PIECE.finditer(text, start, end)]
        for piece in pieces:
            for a, b in uncovered(*piece.span(), covered):
                # the rest of a string of which a pattern covers a part may be short, a name before it not
                rest = (a, b) != piece.span() and b not in named
                if b - a < (SHORTEST["assign"] if rest else SHORTEST_NOVEL):
                    continue
                if not is_name(text[a:b]) and (wrapped or novel(a, b)):
                    found.append((a, b))
                else:
                    found += [core for core in between_names(text, a, b) if core[1] - core[0] >= SHORTEST_NOVEL and novel(*core)]
        if all(len(p[0]) < SHORTEST_NOVEL for p in pieces) and not all(is_name(p[0]) for p in pieces):
            # nothing between two "=" is long enough: the run as it is
            found += [whole for whole in uncovered(start, end, covered) if whole == (start, end) and novel(*whole)]
    start, end = block[-1]
    if found and found[-1][1] == end and end - start >= WRAPPED_CHARS:
        last = LAST_LINE.match(text, end)
        if last and not is_name(last[1]):
            found += uncovered(*last.span(1), covered)
    return found


def scan(text: str | None, novelty: Novelty, threshold: float = NOVELTY) -> list[dict]:
    """All findings by start, then kind."""
    if not text:
        return []
    spans = pattern_spans(text)
    covered, named = merged(spans), {start for start, _, kind in spans if kind == "assign"}
    for block in encoded_blocks(text):
        if SENSITIVE.search(text, max(0, block[0][0] - CONTEXT_CHARS), block[-1][1] + CONTEXT_CHARS):
            spans += [(start, end, "novel") for start, end in novel_spans(text, block, covered, named, novelty, threshold)]
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return [{"kind": kind, "start": start, "end": end, "novelty": novelty(text, start, end)} for start, end, kind in spans]


def findings(text: Column, parts=IDENTIFIER_PARTS, threshold: float = NOVELTY) -> Column:
    """The secrets of a text, as an array ordered by start, then kind; places in code points."""
    dictionary = identifier_dictionary(parts)

    @F.pandas_udf(FINDINGS)
    def scanned(texts: pd.Series) -> pd.Series:
        novelty = novelty_of(dictionary)
        return texts.map(lambda text: scan(text, novelty, threshold))

    return scanned(F.coalesce(text, F.lit("")))


def with_findings(df: DataFrame, text: str = "text", name: str = "findings") -> DataFrame:
    has_columns(df, text)
    return df.withColumn(name, findings(df[text]))


def redacted(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``df`` with a mark in place of every finding; overlapping findings get one.

    ``n_chars``, if there, is set anew for texts that changed.
    """
    has_columns(df, text)
    # the columns in one struct: none of them can clash with a name used here
    whole = df.select(F.struct(*df.columns).alias("_given"), df[text].alias("_text"))
    found, at = with_findings(whole, "_text", "_found"), F.col("_text")
    cut = F.aggregate(
        "_found", F.struct(F.lit("").alias("done"), F.lit(0).alias("upto")),
        lambda acc, f: F.when(f["start"] >= acc["upto"], F.struct(
            F.concat(acc["done"], F.substring(at, acc["upto"] + 1, f["start"] - acc["upto"]), F.lit(mark)).alias("done"),
            f["end"].alias("upto"),
        )).otherwise(F.struct(acc["done"].alias("done"), F.greatest(acc["upto"], f["end"]).alias("upto"))),
        lambda acc: F.concat(acc["done"], F.substring(at, acc["upto"] + 1, F.length(at))),
    )
    changed = F.size("_found") > 0
    result = found.select("_given", changed.alias("_changed"), F.when(changed, cut).otherwise(at).alias("_new"))
    columns = {c: F.col("_given").getField(c) for c in df.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(
            F.col("_changed"), F.length("_new").cast(df.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    columns[text] = F.col("_new")
    return result.select(*[column.alias(name) for name, column in columns.items()])


def op3_secret_scan(spark, sf_dir):
    """Every document with its secrets."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda f: f["kind"] != "novel")
    return with_findings(documents).select(
        "doc_id", *map(number, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
