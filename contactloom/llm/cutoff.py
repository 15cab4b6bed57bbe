"""Texts that were cut off on their way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.session import cut, small

#: A limit may cut a character of several bytes or a blank that is then dropped, so a text cut by it may be this much shorter ...
SLACK = 3
#: ... and where the remains of a character were replaced by U+FFFD, this much longer.
OVER = 2


#: Lengths that a store may limit: of the text, of its encodings, and of its escaped forms.
MEASURES = (
    "chars", "bytes", "utf16", "chars_entities", "bytes_entities", "chars_entities_quotes", "bytes_entities_quotes",
    "chars_json", "bytes_json", "chars_crlf", "bytes_crlf", "chars_lf", "bytes_lf",
)
#: White space that may follow the end of a text.
BLANKS = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Control characters, which JSON writes with six characters.
CONTROLS = "".join(map(chr, [*range(9), 11, 12, *range(14, 32)]))


def lengths(text: Column) -> Column:
    """The lengths of a text by all MEASURES, as an array."""
    chars, octets = F.char_length(text), F.octet_length(text)
    count = lambda some: chars - F.char_length(F.translate(text, some, ""))
    pairs = F.floor((chars - F.char_length(F.replace(text, F.lit("\r\n"), F.lit("")))) / 2)
    entities = 4 * count("&") + 3 * count("<>")
    quotes = 5 * count("\"'")
    json = count("\"\\\n\r\t") + 5 * count(CONTROLS)
    lone = count("\n") - pairs
    utf16 = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    sizes = [
        chars, octets, utf16, chars + entities, octets + entities, chars + entities + quotes, octets + entities + quotes,
        chars + json, octets + json, chars + lone, octets + lone, chars - pairs, octets - pairs,
    ]
    return F.array(*(size.cast("int") for size in sizes))


def with_ending(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds `ending`: how a text ends; open, row, entry, closed, sentence or blank, and null for a null text.

    open: inside a word, sentence, link, template, reference or heading. row: in a table that is not
    closed. entry: with a list entry, which cannot be told from a shortened one by itself. The rest is
    complete: closed markup, a signature, a rule, a heading, the end of a sentence, nothing at all.
    """
    # steps of their own, so that each is computed once
    body = documents.withColumn("_body", F.rtrim(F.col(text), F.lit(BLANKS)))
    lines = body.withColumn("_lines", F.split("_body", r"\r\n|\n|\r"))
    ends = lines.withColumns({
        "_last": F.trim(F.element_at("_lines", -1)),
        "_before": F.trim(F.coalesce(F.get("_lines", F.size("_lines") - 2), F.lit(""))),
    }).drop("_body", "_lines")
    last, before = F.col("_last"), F.col("_before")
    opened = lambda start, end: F.contains(last, F.lit(start)) & ~F.contains(F.substring_index(last, start, -1), F.lit(end))
    # the shape of a list entry: years and other numbers by one sign, words as one
    shape = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?<![0-9])[0-9]{4}(?![0-9])", "Y"), r"[0-9]+", "0"), r"[\p{L}\p{M} ]+", "w")
    listed = r"^[*#;:]"
    sentence = r"[.!?\x{2026}\x{3002}\x{FF01}\x{FF1F}][\"'\x{201D}\x{201C}\x{BB})\]]*$"
    ends_sentence = last.rlike(sentence)
    after_ref = F.substring_index(last, "<ref", -1)
    # in a reference: its tag or its text goes on; a full stop ends it only after the page number or a longer text
    in_ref = F.contains(last, F.lit("<ref")) & ~after_ref.rlike("</ref|/>")
    ref_goes_on = ~ends_sentence | (F.length(after_ref) <= 80) & ~after_ref.rlike(r"[.?!\x{3002}] ?[\p{L}'\[].*[.?!\x{3002}]$") | after_ref.rlike(r"p\.$")
    ending = (
        F.when(last == "", "blank")
        .when(last.endswith("\ufffd"), "open")
        .when(in_ref & ref_goes_on, "open")
        .when((opened("[[", "]]") | opened("{{", "}}") | opened("<!--", "-->") | last.rlike(r"<[/a-zA-Z][^<>]*$")) & ~ends_sentence, "open")
        .when(last.rlike("(?i)#redirect"), "closed")
        # a link in running text, after which the sentence would have gone on
        .when(last.endswith("]]") & last.rlike(r"^[^\[{|*#;:<!=].*\s\S"), "open")
        .when(last.rlike(r"(\]\]|\}\}|\|\}|-->|/>|</[a-zA-Z]+>|~~~~)$"), "closed")
        .when(last.rlike(r"^(=+)[^=]+\1$|^-{4,}$"), "closed")
        .when(ends_sentence, "sentence")
        .when(last.rlike(r"^[|!]|^\{\|"), "row")
        .when(last.rlike(listed), F.when(before.rlike(listed) & (F.substring(before, 1, 1) == F.substring(last, 1, 1)) & (shape(last) != shape(before)), "open").otherwise("entry"))
        # a smile ends a remark without a full stop
        .when(last.rlike(r"[:;]-?[)(DPp]$"), "closed")
        .otherwise("open")
    )
    return ends.withColumn("ending", F.when(F.col(text).isNotNull(), ending)).drop("_last", "_before")


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, source, ending, sizes) of every row that has a text; kept in the checkpoint folder, as it is read again."""
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    return cut(with_ending(rows).select("doc_id", "source", "ending", lengths(F.col("text")).alias("sizes")))


def hidden_limits(sized: DataFrame, least: int = 3, share: float = 0.5, times: float = 4.0, around: int = 32) -> DataFrame:
    """(source, measure, size, n_texts, n_open, n_own): lengths at which texts of a source are cut.

    Texts are counted by source, measure and length. A limit is a length at which at least `least`
    texts end open, these are at least `share` of the texts of this length, and they are `times` as
    many as lengths in the neighbourhood (`around` to either side) have on the average. As a cut text
    has a length by every measure, it then counts for the limit with most open texts only (n_own), and
    a limit with less than `least` of its own is none.
    """
    is_open = F.col("ending").isin("open", "row")
    # (measure, size) as numbers; a measure is an index of MEASURES
    counts = (
        sized.select("source", is_open.alias("_open"), F.posexplode("sizes").alias("_m", "size"))
        .groupBy("source", "_m", "size")
        .agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("_open").alias("n_open"))
    )
    # a neighbourhood lies within a range of 4096 lengths and its margins, so windows are bounded
    part = 4096
    near = Window.partitionBy("source", "_m", "_part").orderBy("size").rangeBetween(-around, around)
    rows = counts.where("n_open > 0").withColumn("_part", F.explode(F.array_distinct(F.array(
        F.floor((F.col("size") - around) / part), F.floor(F.col("size") / part), F.floor((F.col("size") + around) / part)
    ))))
    peaks = (
        rows.withColumn("_near", (F.sum("n_open").over(near) - F.col("n_open")) / F.lit(2.0 * around))
        .where(F.col("_part") == F.floor(F.col("size") / part))
        .where((F.col("n_open") >= least) & (F.col("n_open") >= share * F.col("n_texts")) & (F.col("n_open") >= times * F.col("_near")))
        .select("source", "_m", "size", "n_texts", "n_open")
    )
    own = (
        sized.where(is_open).select("doc_id", "source", F.posexplode("sizes").alias("_m", "size"))
        .join(peaks, ["source", "_m", "size"])
        .groupBy("doc_id", "source").agg(F.max(F.struct("n_open", (-F.col("_m")).alias("_m"), "size", "n_texts")).alias("best"))
        .groupBy("source", F.col("best._m").alias("_m"), F.col("best.size").alias("size"))
        .agg(F.max("best.n_texts").alias("n_texts"), F.max("best.n_open").alias("n_open"), F.count(F.lit(1)).alias("n_own"))
        .where(F.col("n_own") >= least)
    )
    measure = F.element_at(F.array(*map(F.lit, MEASURES)), (1 - F.col("_m")).cast("int"))
    return own.select("source", measure.alias("measure"), F.col("size").cast("long"), "n_texts", "n_open", "n_own")


def truncated(documents: DataFrame, most_limits: int = 100_000) -> DataFrame:
    """(doc_id, source, ending, at_limit, limits, strength, evidence, is_cut) of every document with a text.

    First the lengths under all encodings expose the limits of each source; every text whose length is at
    one is told apart, with the largest part of open texts among those of such a length as strength. Then
    its ending is inspected: a text is cut if it ends open or in an unclosed table row, or, at a limit, with
    a list entry, which by itself cannot be told from a shortened one. A text at a limit that
    ends complete just fits and is not cut. Without any limit the ending alone shows a broken transfer.

    evidence is limit where only the length tells of the cut, both where length and ending do, and ending
    where only the ending does (null for a whole text). Null texts give no row (see truncation_rates),
    blank ones are complete. Repeated rows come out as often as they come in. Null sources count as the
    source ''. Only whole texts are looked at.
    """
    sized = measured(documents)
    limits = cut(hidden_limits(sized).select("source", "measure", F.col("size").cast("int").alias("_limit"), (F.col("n_open") / F.col("n_texts")).alias("_open")))
    # a text belongs to a limit if one of its lengths is there or a little off it: an equi-join on nearby lengths
    nearby = limits.select("source", "measure", "_limit", "_open", F.explode(F.sequence(F.col("_limit") - SLACK, F.col("_limit") + OVER)).alias("_size"))
    nearby = small(nearby, most_limits)
    goes_on = F.col("ending").isin("open", "row")
    at = (
        sized.select("doc_id", "source", "ending", F.posexplode("sizes").alias("_m", "_size"))
        .withColumn("measure", F.element_at(F.array(*map(F.lit, MEASURES)), F.col("_m") + 1))
        .join(nearby, ["source", "measure", "_size"])
        # what is cut inside a character is off the limit; an end that could be whole has to be at it
        .where(goes_on | (F.col("_size") == F.col("_limit")))
        .groupBy("doc_id", "source")
        .agg(F.array_sort(F.collect_set(F.concat_ws(" ", "measure", "_limit"))).alias("limits"), F.max("_open").alias("strength"))
    )
    at_limit = F.col("limits").isNotNull()
    evidence = F.when(goes_on & at_limit, "both").when(goes_on, "ending").when((F.col("ending") == "entry") & at_limit, "limit")
    return (
        sized.select("doc_id", "source", "ending").join(at, ["doc_id", "source"], "left")
        .select("doc_id", "source", "ending", at_limit.alias("at_limit"), "limits", "strength", evidence.alias("evidence"), evidence.isNotNull().alias("is_cut"))
    )


def truncation_rates(documents: DataFrame) -> DataFrame:
    """(source, documents, cut, rate, by_limit, by_ending, both, fitting): how often each source cuts, and by which evidence.

    by_limit, by_ending and both add up to cut; fitting counts complete texts exactly at a limit. Documents
    without a text count as whole.
    """
    counted = {"by_limit": F.col("evidence") == "limit", "by_ending": F.col("evidence") == "ending", "both": F.col("evidence") == "both",
               "fitting": F.col("at_limit") & ~F.col("is_cut")}
    found = truncated(documents).groupBy("source").agg(F.count_if("is_cut").alias("cut"), *(F.count_if(c).alias(k) for k, c in counted.items()))
    every = documents.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("documents"))
    of = {k: F.coalesce(k, F.lit(0)).cast("long") for k in ("cut", *counted)}
    return every.join(found, "source", "left").select(
        "source", "documents", of["cut"].alias("cut"), (of["cut"] / F.col("documents")).alias("rate"), *(of[k].alias(k) for k in counted)
    )
