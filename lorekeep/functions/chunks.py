"""Sentence-aware splitting and structure-aware chunking, inside one row.

Every document is chunked where it is read: no shuffle, no Python worker.
The loops are ``aggregate`` expressions whose state is one buffer plus the
pieces found so far.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions.elements import TITLE_TYPES
from lorekeep.functions.text import bind, strip

# Fixed value: a cut may follow ". ", "! ", "? " or a newline. The match ends
# right behind the punctuation mark or the newline of the last such place.
LAST_BOUNDARY = r"(?s)^.*(?:[.!?](?= )|\n)"

# Characters of the blocks that long texts are cut from.
BLOCK_CHARS = 4096

CHUNKS = (
    "array<struct<chunk_index:int,text:string,parent_text:string,"
    "element_type:string,page_number:int,section:string>>"
)


@dataclass(frozen=True)
class ChunkRules:
    max_chars: int = 1200
    overlap: int = 150
    section_min_chars: int = 400
    table_max_chars: int = 3000
    child_chars: int = 300
    child_overlap: int = 50
    max_chunks: int | None = None


def split_long_text(text: Column, max_chars: int, overlap: int) -> Column:
    """Overlapping parts of at most ``max_chars``, cut at sentence ends if possible.

    A long text is first cut into blocks of fixed size, so that a part is taken
    from one or two blocks and not searched for from the start of the text.
    """
    if not 0 <= overlap < max_chars // 2:
        raise ValueError("overlap must be smaller than half of max_chars")
    quarter, half = max_chars // 4, max_chars // 2
    size = max(BLOCK_CHARS, max_chars)

    def taken(blocks: Column, start: Column, count: Column) -> Column:
        at = F.floor(start / size).cast("int")
        pair = F.concat(F.coalesce(F.get(blocks, at), F.lit("")), F.coalesce(F.get(blocks, at + 1), F.lit("")))
        return F.substring(pair, (start - at * size + 1).cast("int"), count)

    def advance(blocks: Column, n: Column, state: Column, k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(F.greatest(F.lit(0), state["stop"] - overlap))
        return bind(start, lambda s: emit(blocks, n, state, s))

    def emit(blocks: Column, n: Column, state: Column, start: Column) -> Column:
        reach = F.least(start + max_chars, n)
        low = F.greatest(start, reach - quarter)
        tail = F.length(F.regexp_extract(taken(blocks, low, reach - low), LAST_BOUNDARY, 0))
        stop = bind(
            tail,
            lambda t: F.when(
                (reach < n) & (t > 0) & (low + t - 1 > start + half), low + t
            ).otherwise(reach),
        )
        return bind(
            stop,
            lambda e: F.struct(
                e.alias("stop"), F.concat(state["cuts"], F.array(F.struct(start.alias("start"), e.alias("stop")))).alias("cuts")
            ),
        )

    def loop(blocks: Column, n: Column) -> Column:
        # The state is copied in every round, so it holds places and no text.
        start = F.struct(
            F.lit(0).alias("stop"), F.array().cast("array<struct<start:int,stop:int>>").alias("cuts")
        )
        # Each part moves on by more than half - overlap, which bounds the rounds.
        rounds = (n / (half - overlap)).cast("int") + 1
        cuts = F.aggregate(
            F.sequence(F.lit(0), rounds),
            start,
            lambda state, k: F.when((k > 0) & (state["stop"] >= n), state).otherwise(
                advance(blocks, n, state, k)
            ),
            lambda state: state["cuts"],
        )
        parts = F.transform(cuts, lambda c: strip(taken(blocks, c["start"], c["stop"] - c["start"])))
        return F.filter(parts, lambda p: p != "")

    def blocks_of(n: Column) -> Column:
        blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
        return bind(blocks, lambda b: loop(b, n))

    return bind(
        F.length(text),
        lambda n: F.when(n <= max_chars, F.array(text)).otherwise(blocks_of(n)),
    )


def parent_chunks(elements: Column, rules: ChunkRules = ChunkRules()) -> Column:
    """Pack elements into parents; metadata is that of a parent's first element."""

    def prepare(element: Column) -> Column:
        def shape(text: Column) -> Column:
            table = element["element_type"] == "Table"
            long = F.length(text) > rules.max_chars
            cut = split_long_text(text, rules.max_chars, rules.overlap)
            whole = table & (F.length(text) <= rules.table_max_chars)
            own = F.when(whole, F.array(text)).when(table | long, cut)
            return F.struct(
                text.alias("text"),
                own.alias("own"),
                F.struct(
                    element["element_type"].alias("element_type"),
                    element["page_number"].alias("page_number"),
                    element["section"].alias("section"),
                ).alias("meta"),
            )

        return bind(strip(element["text"]), shape)

    prepared = F.transform(
        F.filter(elements, lambda e: e["text"].isNotNull() & (strip(e["text"]) != "")), prepare
    )
    def step(state: Column, sizes: Column) -> Column:
        held, size = state["held"], sizes["size"]
        title_break = (
            sizes["title"] & (held > 0) & (held >= min(rules.section_min_chars, rules.max_chars))
        )
        restart = title_break | sizes["alone"] | (held == 0) | (held + 1 + size > rules.max_chars)
        begun = F.when(restart, F.concat(state["starts"], F.array(sizes["at"])))
        return F.struct(
            F.when(sizes["alone"], 0).when(restart, size).otherwise(held + 1 + size).alias("held"),
            F.coalesce(begun, state["starts"]).alias("starts"),
        )

    def grouped(elements: Column) -> Column:
        sizes = F.transform(
            elements,
            lambda e, i: F.struct(
                i.alias("at"),
                F.length(e["text"]).alias("size"),
                F.coalesce(e["meta"]["element_type"].isin(*TITLE_TYPES), F.lit(False)).alias("title"),
                e["own"].isNotNull().alias("alone"),
            ),
        )
        # As above: the state that every round copies has places only.
        nothing = F.struct(F.lit(0).alias("held"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(sizes, nothing, step, lambda state: state["starts"])
        return bind(starts, lambda found: F.flatten(F.transform(found, lambda s, k: parents_of(elements, found, s, k))))

    def parents_of(elements: Column, starts: Column, start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(starts, k + 1), F.size(elements))
        first = F.get(elements, start)
        text = F.array_join(F.transform(F.slice(elements, start + 1, stop - start), lambda e: e["text"]), "\n")
        return F.transform(
            F.coalesce(first["own"], F.array(text)),
            lambda t: F.struct(t.alias("text"), first["meta"].alias("meta")),
        )

    return bind(prepared, grouped)


def chunk_elements(elements: Column, rules: ChunkRules = ChunkRules()) -> Column:
    """Parent/child chunks of one document, numbered from 0 after the cap."""

    def children(parent: Column) -> Column:
        parts = split_long_text(parent["text"], rules.child_chars, rules.child_overlap)
        return F.transform(
            parts,
            lambda child: F.struct(
                child.alias("text"),
                parent["text"].alias("parent_text"),
                parent["meta"]["element_type"].alias("element_type"),
                parent["meta"]["page_number"].alias("page_number"),
                parent["meta"]["section"].alias("section"),
            ),
        )

    found = F.flatten(F.transform(parent_chunks(elements, rules), children))
    if rules.max_chunks is not None:
        found = F.slice(found, 1, rules.max_chunks)
    return F.transform(
        found,
        lambda c, i: F.struct(
            i.alias("chunk_index"),
            *[
                c[name].alias(name)
                for name in ("text", "parent_text", "element_type", "page_number", "section")
            ],
        ),
    )
