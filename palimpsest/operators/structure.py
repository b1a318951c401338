"""Manuscripts to chapters, paragraphs and mentions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.scratch import keep
from . import automaton

_ENGLISH = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand"
_SPANISH = "uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez|once|doce|trece|catorce|quince|dieciséis|diecisiete|dieciocho|diecinueve|veinte|treinta|cuarenta|cincuenta|sesenta|setenta|ochenta|noventa|cien"
#: Patterns of a line, and its title (fixed values).
MARKDOWN = r"^#{1,3} (.+)$"
CHAPTER = rf"(?iu)^[ \t]*(chapter[ \t]+(?:\d+|[ivxlc]+|{_ENGLISH})\b.*)$"
CAPITULO = rf"(?iu)^[ \t]*(cap[ií]tulo[ \t]+(?:\d+|[ivxlc]+|{_SPANISH})\b.*)$"
ROMAN = r"^[ \t]*([IVXLC]{1,7}\.?)[ \t]*$"
NARRATIVE = r"(?iu)^(pr[oó]logo|prologue|ep[ií]logo|epilogue)(\s*:\s*.+)?$"
NUMBER = r"^\d{1,4}\.?$"
TITLE = r"^[ \t]*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)[ \t]*$"
CAPITALIZED = r"^\p{Lu}\p{Ll}*(\s+\p{Lu}\p{Ll}*){0,7}$"
#: Heading classes in order of preference, with the least headings that a class needs, and the most that are sane.
CLASSES = {"markdown": 2, "chapter": 2, "capitulo": 2, "roman": 2, "narrative": 1, "title": 2, "capitals": 2}
MOST_HEADINGS = 500
#: Bytes of a capital line; characters below which it must be a name of the text, and bytes below which it must stand alone.
LEAST_CAPITALS, MOST_CAPITALS, SHORT_CAPITALS = 3, 60, 10
#: Bytes of a packed part.
PART = 50000


def all_capitals(line: Column) -> Column:
    """A trimmed line of 3 to 60 bytes without lower-case letters, with three capitals at least, and no sentence's end."""
    size = F.octet_length(line)
    return (size >= LEAST_CAPITALS) & (size <= MOST_CAPITALS) & ~line.rlike(r"[.!?\"»,;:]$") & ~line.rlike(r"\p{Ll}") & line.rlike(r"(\p{Lu}[^\p{Lu}]*){3}")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def names_in_prose(lines: Column, asked: Column) -> Column:
    """Those of the ``asked`` names that stand, with a capital, after another word of a sentence in a line that is not in capitals."""
    words = lambda s: F.filter(F.filter(F.split(s, r"[^\p{L}]+"), lambda w: w != ""), lambda w, i: (i > 0) & w.rlike(r"^\p{Lu}"))
    prose = F.filter(lines, lambda r: ~r["capital"])
    said = F.flatten(F.transform(prose, lambda r: F.flatten(F.transform(F.split(r["line"], "[.!?]"), words))))
    return F.when(F.size(asked) > 0, F.array_intersect(asked, said)).otherwise(asked)


def classified(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text, lines, marked): every line of each text, and (n, line, trimmed, heads, inside) of those that some class takes.

    ``heads`` are the classes by which line n begins a heading, ``inside`` those by which it belongs to one. Lines in capitals of fewer than
    ten characters are headings only if their name stands in the prose, and only between blank lines. A number and the title-case line after
    it are one heading, and so are title-case lines with nothing between them. A text is told in one pass over its row, without a shuffle.
    """
    told = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.split(text, "\n").alias("_lines"))
    full = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("n"), x.alias("line"), trimmed(x).alias("trimmed"))), lambda r: r["trimmed"] != "")
    name = lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, MOST_CAPITALS)))

    def facts(r: Column) -> Column:
        return F.struct(
            r["n"].alias("n"), r["line"].alias("line"), r["trimmed"].alias("trimmed"), all_capitals(r["trimmed"]).alias("capital"),
            r["trimmed"].rlike(NUMBER).alias("bare"), r["trimmed"].rlike(CAPITALIZED).alias("cased"), r["line"].rlike(TITLE).alias("title"),
        )

    told = told.withColumn("_full", F.transform(full, facts))
    short = F.filter("_full", lambda r: r["capital"] & (F.char_length(r["trimmed"]) < SHORT_CAPITALS) & ~F.contains(r["trimmed"], F.lit(" ")))
    told = told.withColumn("_asked", F.array_distinct(F.transform(short, lambda r: name(r["trimmed"]))))
    told = told.withColumn("_known", names_in_prose(F.col("_full"), F.col("_asked")))

    def mark(r: Column, j: Column) -> Column:
        before, after = F.get("_full", j - 1), F.get("_full", j + 1)
        yes = lambda c: F.coalesce(c, F.lit(False))
        alone = F.coalesce(before["n"] < r["n"] - 1, F.lit(True)) & F.coalesce(after["n"] > r["n"] + 1, F.lit(True))
        known = (F.char_length(r["trimmed"]) >= SHORT_CAPITALS) | F.array_contains("_known", name(r["trimmed"]))
        heads = {
            "markdown": r["line"].rlike(MARKDOWN), "chapter": r["line"].rlike(CHAPTER), "capitulo": r["line"].rlike(CAPITULO), "roman": r["line"].rlike(ROMAN),
            "narrative": r["trimmed"].rlike(NARRATIVE) | (r["bare"] & yes(after["cased"])), "title": r["title"] & ~yes(before["title"]),
            "capitals": r["capital"] & ((F.octet_length(r["trimmed"]) >= SHORT_CAPITALS) | alone) & known,
        }
        follows = {"narrative": r["cased"] & yes(before["bare"]), "title": r["title"]}
        names = lambda flags: F.array_compact(F.array(*[F.when(f, F.lit(c)) for c, f in flags.items()]))
        return F.struct(r["n"].alias("n"), r["line"].alias("line"), r["bare"].alias("bare"), names(heads).alias("heads"), names(follows).alias("follows"))

    told = told.withColumn("_marked", F.filter(F.transform("_full", mark), lambda r: (F.size(r["heads"]) > 0) | (F.size(r["follows"]) > 0)))
    inside = lambda r: r.withField("inside", F.array_union(r["heads"], r["follows"])).dropFields("follows")
    return told.select(F.col("_key").alias(key), F.col("_text").alias("text"), F.col("_lines").alias("lines"), F.transform("_marked", inside).alias("marked"))


def heading_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line, class): lines that begin a heading, for each class that takes them."""
    told = classified(docs, key, text).select(key, F.inline("marked"))
    return told.select(key, F.col("n").alias("line_no"), "line", F.explode("heads").alias("class"))


def split_chapters(docs: DataFrame, key: str, text: str = "text", most: int = PART) -> DataFrame:
    """(key, seq, title, body): the first class with enough headings cuts; what stands before them is Front Matter; empty bodies go.

    A document without such a class is packed into parts of ``most`` bytes. Every row is a document of its own, cut where it is read.
    """
    told = classified(docs, key, text).withColumn("_flat", F.flatten(F.transform("marked", lambda r: r["heads"])))
    count = lambda c: F.size(F.filter("_flat", lambda x: x == c))
    told = told.withColumn("_class", F.coalesce(*[F.when((count(c) >= n) & (count(c) <= MOST_HEADINGS), F.lit(c)) for c, n in CLASSES.items()]))
    label = F.col("_class")
    told = told.withColumn("_mine", F.filter("marked", lambda r: F.array_contains(r["inside"], label)))
    told = told.withColumn("_starts", F.transform(F.filter("_mine", lambda r: F.array_contains(r["heads"], label)), lambda r: r["n"]))
    join = lambda x: trimmed(F.array_join(x, "\n"))

    def said(r: Column) -> Column:  # of a number and a title only the title counts
        return F.when(label == "markdown", F.regexp_extract(r["line"], MARKDOWN, 1)).when((label == "narrative") & r["bare"], F.lit("")).otherwise(r["line"])

    def chapter(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get("_starts", i + 1), F.size("lines"))
        heading = F.filter("_mine", lambda r: (r["n"] >= start) & (r["n"] < end))
        last = F.element_at(heading, -1)["n"]
        between = F.slice("lines", start + 1, last - start + 1)  # blank lines of a heading stay in its title
        title = F.when(F.size(heading) == 1, trimmed(said(heading[0]))).when(label == "narrative", join(F.slice(between, 2, F.size(between)))).otherwise(join(between))
        return F.struct((i + 1).cast("long").alias("seq"), title.alias("title"), join(F.slice("lines", last + 2, end - last - 1)).alias("body"))

    front = F.struct(F.lit(0).cast("long").alias("seq"), F.lit("Front Matter").alias("title"), join(F.slice("lines", 1, F.col("_starts")[0])).alias("body"))
    cut = F.filter(F.concat(F.array(front), F.transform("_starts", chapter)), lambda r: r["body"] != "")
    parts = F.transform(_packed(F.col("text"), most, "\n\n"), lambda r: F.struct(r["part"].cast("long").alias("seq"), r["title"].alias("title"), r["body"].alias("body")))
    return told.select(key, F.inline(F.when(label.isNotNull(), cut).otherwise(parts)))


def _packed(text: Column, most: int, between: str) -> Column:
    """Array of (part, title, body); a blank text has none."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(a: Column, p: Column) -> Column:
        fits = F.octet_length(a["now"]) + F.octet_length(p) <= most
        joined = F.when(a["now"] == "", p).otherwise(F.concat(a["now"], F.lit(between), p))
        return F.when(fits | (a["now"] == ""), F.struct(a["done"].alias("done"), joined.alias("now"))).otherwise(F.struct(F.array_append(a["done"], a["now"]).alias("done"), p.alias("now")))

    body = trimmed(text)
    paragraphs = F.filter(F.transform(F.split(body, between), trimmed), lambda p: p != "")
    packs = F.aggregate(paragraphs, start, add, lambda a: F.array_append(a["done"], a["now"]))
    part = lambda p, i, title: F.struct(i.alias("part"), title.alias("title"), p.alias("body"))
    whole = F.array(part(body, F.lit(0), F.lit("Untitled")))
    many = F.transform(packs, lambda p, i: part(p, i, F.concat(F.lit("Part "), (i + 1).cast("string"))))
    return F.when(body == "", F.array().cast("array<struct<part:int,title:string,body:string>>")).when(F.octet_length(body) <= most, whole).otherwise(many)


def pack_paragraphs(docs: DataFrame, key: str, text: str = "text", most: int = PART, between: str = "\n\n") -> DataFrame:
    """(key, part, title, body): a text of ``most`` bytes at most as it is; else its paragraphs, joined until the next would pass them.

    Blank texts have no part. The mark between paragraphs counts once it stands between two.
    """
    return docs.select(key, F.inline(_packed(F.col(text), most, between)))


def paragraphs(chapters: DataFrame, keys: list[str], between: str = "\n\n", most: int = 30000) -> DataFrame:
    """Rows (keys, paragraph_index, offset, text): index over all parts, byte offset of the trimmed text; blank parts and those of more than ``most`` bytes go.

    All white space of Unicode is trimmed.
    """
    parts = chapters.select(*keys, F.posexplode(F.split("text", between)).alias("paragraph_index", "part"))
    order = Window.partitionBy(*keys).orderBy("paragraph_index").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("part") + len(between)).over(order), F.lit(0))
    lead = F.octet_length("part") - F.octet_length(F.regexp_replace("part", r"(?U)^\s+", ""))
    out = parts.select(*keys, "paragraph_index", (before + lead).cast("long").alias("offset"), F.regexp_replace("part", r"(?U)^\s+|\s+$", "").alias("text"))
    return out.where((F.col("text") != "") & (F.octet_length("text") <= most))


def locate_mentions(names: DataFrame, paras: DataFrame, keys: list[str]) -> DataFrame:
    """Each (name, chapter): first paragraph that holds the name in any case, else the chapter's first; 0-based place or -1.

    Names are a short list asked of every paragraph; each meets the paragraphs of its own chapters only.
    """
    pairs = paras.join(names.hint("merge"), keys)
    at = F.instr(F.lower("text"), F.lower("name"))
    best = pairs.groupBy(*keys, "name").agg(F.min(F.when(at > 0, F.struct("paragraph_index", "text"))).alias("hit"), F.min(F.struct("paragraph_index", "text")).alias("first"))
    row = F.coalesce("hit", "first")
    return best.select(*keys, "name", row["paragraph_index"].alias("paragraph_index"), (F.instr(F.lower(row["text"]), F.lower("name")) - 1).alias("at"), row["text"].alias("text"))


#: Bytes of names in a shard of the lexicon, bytes of automata that are broadcast at once, and characters of text that are matched at once.
SHARD_BYTES, PASS_BYTES, MATCHED_CHARS = 1 << 20, 128 << 20, 1 << 20


def lexicon_automata(names: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, automaton) of the different names, ids the smallest of each; every shard is built by one task from at most some ``shard_bytes``."""
    known = names.select(F.lower(F.regexp_replace("name", r"^\s+|\s+$", "")).alias("norm"), F.col("entity_id").cast("long").alias("entity_id")).where("norm <> ''").groupBy("norm").agg(F.min("entity_id").alias("entity_id"))
    known = keep(known)
    total = known.agg(F.sum(F.octet_length("norm"))).first()[0] or 0
    shards = -(-total // shard_bytes)
    dealt = known.withColumn("shard", F.pmod(F.xxhash64("norm"), F.lit(max(1, shards))))

    def build(given: pa.Table) -> pa.Table:
        made = automaton.Automaton(given.column("norm").to_pylist(), given.column("entity_id").to_pylist())
        return pa.table({"shard": given.column("shard")[:1], "automaton": pa.array([made.dump()], pa.binary())})

    return keep(dealt.groupBy("shard").applyInArrow(build, "shard long, automaton binary"))


def match_gazetteer(paras: DataFrame, names: DataFrame, key: str, shard_bytes: int = SHARD_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(key, entity_id, start, end, form): names found in any case between word boundaries, from left to right, the longest of each place.

    Names become automata over their pieces, in shards of bounded size. As many as fit ``pass_bytes`` are broadcast together, and texts
    are matched where they are read; only a larger lexicon takes more passes, whose matches then meet by text. What a found name covers is
    not searched again, and a sign stands between two names. A name of several entities is the smallest one's; names may have any length and signs.
    """
    shards = lexicon_automata(names, shard_bytes)
    passes: list[list[int]] = []
    left = 0
    for r in shards.select("shard", F.octet_length("automaton").alias("n")).orderBy("shard").collect():  # a row for each shard
        if not passes or r.n > left:
            passes, left = [*passes, []], pass_bytes
        passes[-1].append(r.shard)
        left -= r.n
    told = paras.select(key, "text", F.lower("text").alias("low")).where("text IS NOT NULL")
    kind = paras.schema[key].dataType
    span = T.StructType([T.StructField(key, kind), *[T.StructField(c, T.LongType()) for c in ("entity_id", "start", "end")], T.StructField("form", T.StringType())])
    placed = T.StructType([*span.fields, T.StructField("text", T.LongType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])

    def matcher(sent, alone: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automata = [automaton.load(x) for x in sent.value]
            for batch in batches:
                low, text = batch.column(2).to_pylist(), batch.column(1).to_pylist()
                ends = np.cumsum([len(t) for t in low]) // MATCHED_CHARS if low else np.zeros(0)
                for part in np.split(np.arange(len(low)), np.flatnonzero(np.diff(ends)) + 1):
                    found = [a.found([low[i] for i in part]) for a in automata]
                    row, start, end, entity, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
                    order = np.lexsort((entity, -last, first, row))
                    row, start, end, entity, first, last = (x[order] for x in (row, start, end, entity, first, last))
                    if alone:
                        kept = automaton.leftmost_longest(row, first, last)
                        row, start, end, entity, first, last = (x[kept] for x in (row, start, end, entity, first, last))
                    at = part[row] if len(row) else row
                    form = [text[i][x:y] for i, x, y in zip(at.tolist(), start.tolist(), end.tolist(), strict=True)]
                    columns = [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(x, pa.int64()) for x in (entity, start, end)], pa.array(form, pa.string())]
                    if not alone:
                        columns += [batch.column(3).take(pa.array(at, pa.int64())), *[pa.array(x, pa.int64()) for x in (first, last)]]
                    yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in (span if alone else placed).fields])

        return run

    def shard_pass(chosen: list[int], alone: bool) -> DataFrame:
        sent = paras.sparkSession.sparkContext.broadcast([bytes(r.automaton) for r in shards.where(F.col("shard").isin(chosen)).collect()])  # PASS_BYTES and one shard at most
        source = told if alone else told.withColumn("text_id", F.xxhash64("text"))
        return source.mapInArrow(matcher(sent, alone), span if alone else placed)

    if len(passes) < 2:
        return shard_pass(passes[0] if passes else [], True) if passes else paras.sparkSession.createDataFrame([], span)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first, last = (np.array([p[c] for p in places]) for c in ("first", "last"))
                kept = automaton.leftmost_longest(np.zeros(len(places), int), first, -last)
                out += [(k, p["entity"], p["start"], p["end"], p["form"]) for p, good in zip(places, kept.tolist(), strict=True) if good]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.field(0).type, *[pa.int64()] * 3, pa.string()], strict=True)], names=span.names)

    found = reduce(DataFrame.unionByName, [keep(shard_pass(chosen, False)) for chosen in passes])
    place = F.struct("first", (-F.col("last")).alias("last"), F.col("entity_id").alias("entity"), "start", "end", "form")
    return found.groupBy(key, "text").agg(F.array_sort(F.collect_list(place)).alias("places")).select(key, "places").mapInArrow(settle, span)


def truncate_to_tokens(paras: DataFrame, key: str, order: str, budget: int) -> DataFrame:
    """Paragraphs from the first until one does not fit; an oversized first is cut to its longest prefix that fits."""
    w = Window.partitionBy(key).orderBy(order)
    cost = X.count_tokens(F.col("text"))
    told = paras.withColumn("tokens", cost).withColumn("used", F.sum("tokens").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    kept = told.where((F.col("used") <= budget) | F.col("_first")) if budget > 0 else told.where(F.lit(False))
    return kept.select(key, order, F.when(F.col("used") <= budget, F.col("text")).otherwise(X.longest_prefix(F.col("text"), budget)).alias("text"))


def cap_corpus(chunks: DataFrame, key: str, order: str, most: int = 12000) -> DataFrame:
    """Chunks of a key in order until ``most`` bytes, two between chunks; the last is cut to whole characters."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(most) - F.coalesce(F.sum(F.octet_length("text") + 2).over(w), F.lit(0))
    return chunks.withColumn("_left", left).where("_left > 0").select(key, order, X.byte_prefix(F.col("text"), F.col("_left")).alias("text"))


def conversation_tokens(turns: DataFrame, calls: str | None = None) -> DataFrame:
    """Two, and four and the role's and content's tokens for each message, and those of its tool calls (a column of JSON text, which may be null)."""
    cost = 4 + X.count_tokens(F.col("role")) + X.count_tokens(F.col("text"))
    cost = cost if calls is None else cost + X.count_tokens(F.coalesce(calls, F.lit("")))
    return turns.groupBy("conv_id").agg((F.lit(2) + F.sum(cost)).alias("tokens"))


def compaction_plan(turns: DataFrame, usable: int) -> DataFrame:
    """What happens to each message once a conversation passes 80 % of the usable tokens: keep, summarize or tail."""
    total = conversation_tokens(turns)
    last = turns.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("boundary"))
    told = turns.join(total, "conv_id").join(last, "conv_id")
    act = (F.col("tokens") * 100 > 80 * usable) & (F.coalesce("boundary", F.lit(0)) > 2)
    label = F.when(~act | (F.col("turn") < 2), "keep").when(F.col("turn") <= F.col("boundary"), "summarize").otherwise("tail")
    return told.select("conv_id", "turn", label.alias("action"))


#: What shows no text: comments, scripts, styles, declarations; and a tag with its attributes, the name in the first or second group.
SILENT = r"(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|<[!?][^>]*>"
TAG = r"<(/?[A-Za-z][A-Za-z0-9:-]*)(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<(/?[A-Za-z][A-Za-z0-9:-]*)[^>]*>"
#: Marks of tags in Markdown; \u0003 is the mark of a list item, which takes in the white space after it.
MARKS = {
    **{f"h{n}": "\n\n" + "#" * n + " " for n in range(1, 7)}, **{f"/h{n}": "\n\n" for n in range(1, 7)}, **{t: "*" for t in ("em", "/em", "i", "/i")}, **{t: "**" for t in ("strong", "/strong", "b", "/b")},
    **{t: "\n\n" for t in ("p", "/p", "/ul", "/ol", "blockquote", "/blockquote")}, "br": "\n", "hr": "\n\n---\n\n", "li": "\n\u0003",
}


def markdown_of_html(html: Column) -> Column:
    """Headings, emphasis, lists, rules and line breaks as Markdown, other tags dropped, references decoded; plain expressions in one pass over the tags.

    Blocks are trimmed, blank ones go, and a blank line parts those that stay. A text without any tag stays as it is, but for white space at its ends. A tag with an unclosed quotation mark ends at the next bracket.
    """
    bare = F.regexp_replace(F.translate(F.regexp_replace(html, r"\r\n?", "\n"), "\u0001\u0002\u0003", ""), SILENT, "")
    pieces = F.split(F.regexp_replace(bare, TAG, "\u0001$1$2\u0002"), "\u0001")
    mark = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])

    def written(piece: Column, i: Column) -> Column:
        name, text = F.substring_index(piece, "\u0002", 1), F.substring_index(piece, "\u0002", -1)
        return F.when(i == 0, piece).otherwise(F.concat(F.coalesce(F.try_element_at(mark, F.lower(name)), F.lit("")), text))

    told = X.decode_references(F.array_join(F.transform(pieces, written), ""))
    told = F.regexp_replace(told, "\u0003\\s*", "- ")
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    blocks = F.array_join(F.filter(F.transform(F.split(told, "\n\n"), strip), lambda b: b != ""), "\n\n")
    return F.when(F.contains(html, F.lit("<")), blocks).otherwise(strip(html))


def html_to_markdown(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """(key, markdown) of each page; a page without text has an empty one."""
    return pages.select(key, markdown_of_html(F.coalesce(source, F.lit(""))).alias("markdown"))


def markdown_to_html(text: Column) -> Column:
    """Paragraphs, line breaks, three heading levels, strong and emphasis, scene breaks; plain expressions on escaped text."""
    safe = text
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(sign), F.lit(name))

    def block(p: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(p, r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), r"\*([^*]+)\*", "<em>$1</em>")
        out = F.concat(F.lit("<p>"), F.replace(inner, F.lit("\n"), F.lit("<br>")), F.lit("</p>"))
        for n in (3, 2, 1):
            out = F.when(inner.startswith("#" * n + " "), F.concat(F.lit(f"<h{n}>"), F.substring(inner, n + 2, 1 << 30), F.lit(f"</h{n}>"))).otherwise(out)
        return F.when(F.trim(p).isin("***", "---", "* * *"), F.lit("<hr>")).otherwise(out)

    return F.array_join(F.transform(F.filter(F.split(safe, r"\n\s*\n"), lambda p: F.trim(p) != ""), block), "\n")


