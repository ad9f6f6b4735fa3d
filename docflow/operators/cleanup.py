"""Markdown clean-up: C1-C3 and the lint rules R1-R18, as passes over lines.

A pass takes lines (doc_id, line_no, line, ...) and returns them rewritten, with a count of
what it changed in column n_<rule> of the lines concerned. Rules protect fenced code (F) or
fenced code and front matter (S).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import text as T

from . import lines as L

WS = T.WS
Pass = Callable[[DataFrame], DataFrame]

# Fixed values.
PAGE_NUMBERS = (
    rf"^{WS}*\d{{1,4}}{WS}*\z",
    rf"^{WS}*[-–—]{WS}*\d{{1,4}}{WS}*[-–—]{WS}*\z",
    rf"^{WS}*\d{{1,4}}{WS}*/{WS}*\d{{1,4}}{WS}*\z",
    rf"(?i)^{WS}*page{WS}+\d{{1,4}}({WS}+of{WS}+\d{{1,4}})?{WS}*\z",
    rf"(?i)^{WS}*\d{{1,4}}{WS}+of{WS}+\d{{1,4}}{WS}*\z",
)
BULLETS = "•‣⁃∙●○◦▪▫□◾◼◻"
LINE_BREAKS = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
URL = r"((?:^|[\s\x1c-\x1f]|(?<!\])\())(https?://[^\s\x1c-\x1f<>)\]`]+?)([.,;:!?]?(?=$|[\s\x1c-\x1f)]))"
HEADING_MARKS = ".,;:!"
ITEM_END = ".!?:;"


def _counted(lines: DataFrame, rule: str, hit: Column, line: Column, n: Column | None = None) -> DataFrame:
    """Rewrite the lines where hit holds, and count 1 (or n) there."""
    hit = F.coalesce(hit, F.lit(False))
    return lines.select("*", hit.alias("_hit")).withColumns({f"n_{rule}": F.when(F.col("_hit"), F.lit(1) if n is None else n).otherwise(0), "line": F.when(F.col("_hit"), line).otherwise(F.col("line"))}).drop("_hit")


# --- passes of the conversion worker -------------------------------------------------


def strip_empty_headings(docs: DataFrame, text: str = "text") -> DataFrame:
    """Drop headings without text and take the mark off headings that are one image.

    Adds altered. Text is cut at every Unicode line break, and joined by newlines; a final
    newline stays. Fences do not protect.
    """
    parts = F.split(F.col(text), LINE_BREAKS, -1)
    parts = F.when(T.last_char(text).rlike(rf"(?:{LINE_BREAKS})") | (F.col(text) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    empty = lambda x: T.has(x, rf"^#{{1,6}}{WS}*\z")
    image = rf"^#{{1,6}}{WS}+(!\[[^\]]*\]\([^)]*\)){WS}*\z"
    out = docs.withColumn("_parts", parts)
    kept = F.transform(F.filter("_parts", lambda x: ~empty(x)), lambda x: T.sub(x, image, "$1"))
    joined = F.concat(F.array_join(kept, "\n"), F.when(F.endswith(F.col(text), F.lit("\n")), "\n").otherwise(""))
    altered = F.size(F.filter("_parts", lambda x: empty(x) | T.has(x, image)))
    return out.withColumns({"altered": altered, text: joined}).drop("_parts")


def running_lines(lines: DataFrame, min_repeats: int = 3, min_length: int = 8) -> DataFrame:
    """C2's flag: boiler, on lines whose stripped text stands min_repeats times among eligible lines."""
    bare = T.strip("line")
    fit = ~F.col("in_fence") & (F.char_length("_bare") >= min_length) & ~F.startswith("_bare", F.lit("#")) & ~T.has("line", L.LIST_ITEM)
    out = L.with_fence(lines).withColumn("_bare", bare).withColumn("_fit", fit)
    same = Window.partitionBy(L.KEY, "_bare")
    return out.withColumn("boiler", F.col("_fit") & (F.count_if(F.col("_fit")).over(same) >= min_repeats)).drop("_bare", "_fit")


def strip_headers_footers(lines: DataFrame, min_repeats: int = 3, min_length: int = 8) -> DataFrame:
    """Remove running headers and footers."""
    return running_lines(lines, min_repeats, min_length).filter(~F.col("boiler")).drop("boiler", "in_fence")


def page_number(c: Column | str = "line") -> Column:
    found = F.lit(False)
    for p in PAGE_NUMBERS:
        found = found | T.has(c, p)
    return found


def page_number_lines(lines: DataFrame) -> DataFrame:
    """C3's flag: page_no, on page numbers that stand alone between blank lines or edges, outside fences."""
    alone = ~L.needs_blank_before() & ~L.needs_blank_after()
    return L.with_fence(lines).withColumn("page_no", ~F.col("in_fence") & page_number() & alone)


def strip_page_numbers(lines: DataFrame) -> DataFrame:
    """Remove them."""
    return page_number_lines(lines).filter(~F.col("page_no")).drop("page_no", "in_fence")


# --- lint rules, on lines with in_fence, fm_end and skip ------------------------------


def form_feeds(lines: DataFrame) -> DataFrame:
    """Remove form feeds, each counted."""
    bare = F.translate("line", "\x0c", "")
    return _counted(lines, "formfeed", F.contains("line", F.lit("\x0c")), bare, F.char_length("line") - F.char_length(bare))


def hard_tabs(lines: DataFrame) -> DataFrame:
    """R2 (S): a tab becomes four spaces."""
    return _counted(lines, "md010", ~F.col("skip") & F.contains("line", F.lit("\t")), F.replace("line", F.lit("\t"), F.lit("    ")))


def title_in_front_matter(lines: DataFrame) -> DataFrame:
    """R3 (F): where front matter has a title, the first heading of level 1 after it gains a #."""
    titled = F.max((T.has("line", rf"(?i)^{WS}*title{WS}*:{WS}*{T.NON_WS}") & (F.col("line_no") < F.col("fm_end"))).cast("int")).over(L.whole()) == 1
    body = T.lstrip("line")
    h1 = (F.col("line_no") >= F.col("fm_end")) & ~F.col("in_fence") & (F.startswith(body, F.lit("# ")) | (body == "#"))
    first = F.min(F.when(h1, F.col("line_no"))).over(L.whole())
    out = lines.withColumn("_first", F.when(titled & (F.col("fm_end") > 0), first))
    return _counted(out, "md025", F.col("line_no") == F.col("_first"), T.sub("line", f"^({WS}*)#", "$1##")).drop("_first")


def trailing_white_space(lines: DataFrame) -> DataFrame:
    """R4 (S): off, but for exactly two spaces after text."""
    bare = T.rstrip("line")
    soft = (F.char_length("line") - F.char_length(bare) == 2) & F.endswith("line", F.lit("  ")) & (bare != "")
    new = F.concat(bare, F.when(soft, "  ").otherwise(""))
    return _counted(lines, "md009", ~F.col("skip") & (new != F.col("line")), new)


def missing_hash_space(lines: DataFrame) -> DataFrame:
    """R5 (S): #Foo becomes # Foo."""
    p = rf"^({WS}*)(#{{1,6}})([^# \t].*)\z"
    return _counted(lines, "md018", ~F.col("skip") & T.has("line", p), T.sub("line", p, "$1$2 $3"))


def heading_punctuation(lines: DataFrame) -> DataFrame:
    """R6 (S): headings lose the marks . , ; : ! at their end."""
    p = rf"^({WS}*)(#{{1,6}})[ \t]*(.*?){WS}*\z"
    title = T.group("line", p, 3)
    bare = T.sub(title, rf"(?:{WS}*[{HEADING_MARKS}])+\z", "")
    hit = ~F.col("skip") & T.has("line", L.HEADING) & (title != "") & (bare != title)
    return _counted(lines, "md026", hit, F.concat(T.group("line", p, 1), T.group("line", p, 2), F.lit(" "), bare))


def bare_urls(lines: DataFrame) -> DataFrame:
    """R7 (S): bare URLs go into angle brackets, outside code spans; each counted."""
    p = "(?mU)" + URL
    parts = F.split("line", "`", -1)
    new = F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 0, F.regexp_replace(s, p, "$1<$2>$3")).otherwise(s)), "`")
    n = F.aggregate(F.transform(parts, lambda s, i: F.when(i % 2 == 0, F.regexp_count(s, F.lit(p))).otherwise(0)), F.lit(0), lambda a, x: a + x)
    out = lines.withColumn("_n", F.when(~F.col("skip") & F.contains("line", F.lit("://")), n).otherwise(0))
    return _counted(out, "md034", F.col("_n") > 0, new, F.col("_n")).drop("_n")


def unicode_bullets(lines: DataFrame) -> DataFrame:
    """R8 (F): a bullet glyph before text becomes a list mark."""
    p = rf"^({WS}*)[{BULLETS}]{WS}+({T.NON_WS}.*)\z"
    return _counted(lines, "bullet", ~F.col("in_fence") & T.has("line", p), T.sub("line", p, "$1- $2"))


def numbered_headings(lines: DataFrame) -> DataFrame:
    """R9 (S): numbered section titles become headings.

    A title is at most 50 characters and 7 words and does not end in . : , ; or !. A single
    number is one only if the nearest lines with text are no numbered items.
    """
    p = rf"^(\d+(?:\.\d+)+|\d+\.){WS}+({T.NON_WS}.*?){WS}*\z"
    num, title = T.group("line", p, 1), T.group("line", p, 2)
    depth = F.size(F.split(F.rtrim(num, F.lit(".")), r"\.", -1))
    item = F.when(~L.blank(), T.has("line", L.NUMBERED_ITEM))
    above = F.last(item, True).over(L.ordered().rowsBetween(Window.unboundedPreceding, -1))
    below = F.first(item, True).over(L.ordered().rowsBetween(1, Window.unboundedFollowing))
    near = F.coalesce(above, F.lit(False)) | F.coalesce(below, F.lit(False))
    out = lines.withColumn("_near", near)
    hit = ~F.col("skip") & ~T.has("line", L.HEADING) & ~T.has("line", L.BULLET_ITEM) & T.has("line", p)
    hit = hit & (F.char_length(title) <= 50) & (F.size(T.words(title)) <= 7) & ~T.last_char(title).isin(*".:,;!") & ((depth > 1) | ~F.col("_near"))
    return _counted(out, "heading", hit, F.concat(F.repeat(F.lit("#"), F.least(depth + 1, F.lit(6))), F.lit(" "), num, F.lit(" "), title)).drop("_near")


def list_continuations(lines: DataFrame) -> DataFrame:
    """R10 (F): running lines after a list item fold into it; islands between lines that cannot continue one."""
    ends = T.last_char(T.rstrip(L.before("line"))).isin(*ITEM_END)
    item = T.has("line", L.LIST_ITEM)
    breaks = F.col("in_fence") | L.blank() | item | T.has("line", L.BLOCK_START) | F.coalesce(ends, F.lit(False))
    out = lines.withColumns({"_brk": breaks, "_item": item & ~F.col("in_fence")})
    out = out.withColumn("_grp", F.sum(F.col("_brk").cast("int")).over(L.upto()))
    island = Window.partitionBy(L.KEY, "_grp").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    listed = F.first(F.col("_item") & F.col("_brk")).over(island)
    out = out.withColumn("_head", F.when(listed, F.first("line_no").over(island)).otherwise(F.col("line_no")))
    counts = [c for c in lines.columns if c.startswith("n_")]  # a folded line's counts go to its item
    rest = [c for c in lines.columns if c not in (L.KEY, "line", "line_no", *counts)]
    parts = F.sort_array(F.collect_list(F.struct("line_no", "line")))  # each line is gathered once, with its item
    packed = out.groupBy(L.KEY, F.col("_head").alias("line_no")).agg(parts.alias("_all"), *(F.sum(c).alias(c) for c in counts), *(F.min_by(c, "line_no").alias(c) for c in rest))
    more = F.transform(F.slice("_all", 2, F.size("_all")), lambda x: T.strip(x["line"]))
    first = F.get("_all", F.lit(0))["line"]
    packed = packed.withColumn("line", F.when(F.size("_all") > 1, F.concat_ws(" ", T.rstrip(first), F.array_join(more, " "))).otherwise(first))
    packed = packed.withColumn("n_rejoin", F.size("_all") - 1)
    return packed.select(*lines.columns, "n_rejoin")


def bare_callouts(lines: DataFrame) -> DataFrame:
    """R11 (F): a line that is only N) has its parenthesis escaped."""
    p = rf"^({WS}*)(\d{{1,3}})\){WS}*\z"
    return _counted(lines, "callout", ~F.col("in_fence") & T.has("line", p), T.sub("line", p, r"$1$2\\)"))


def _list_fold(items: Column) -> Column:
    """R12's blocks: (num, block, rank) of each ordered item, block 0 for items inside another list's block.

    A block goes on as long as lines are its items, blank, or start with its indent and a
    space. That depends on its first item, so it is a fold over the items in order. lo and hi
    of an item are the least and greatest of the lines with text up to the next item: if both
    start with a prefix, all of them do. cut tells of a skipped line among them.
    """
    start = F.struct(
        F.lit(None).cast("string").alias("indent"), F.lit(None).cast("string").alias("delim"), F.lit(0).alias("block"), F.lit(0).alias("rank"),
        F.lit(None).cast("string").alias("lo"), F.lit(None).cast("string").alias("hi"), F.lit(False).alias("cut"),
        F.array().cast("array<struct<num: string, block: int, rank: int>>").alias("out"),
    )

    def step(a, x):
        deeper = F.concat(a["indent"], F.lit(" "))
        fits = lambda c: F.coalesce(F.startswith(c, deeper), F.lit(True))
        going = a["indent"].isNotNull() & ~a["cut"] & fits(a["lo"]) & fits(a["hi"])
        peer = (x["indent"] == a["indent"]) & (x["delim"] == a["delim"])
        kind = F.when(~F.coalesce(going, F.lit(False)), 0).when(peer, 1).when(F.startswith(x["line"], deeper), 2).otherwise(0)

        def after(k):  # 0 opens a block, 1 is the block's next item, 2 lies inside it
            block = F.when(k == 0, a["block"] + 1).otherwise(a["block"])
            rank = F.when(k == 0, 1).when(k == 1, a["rank"] + 1).otherwise(a["rank"])
            mine = F.struct(x["num"].alias("num"), F.when(k == 2, 0).otherwise(block).alias("block"), rank.alias("rank"))
            opened = lambda c: F.when(k == 0, x[c]).otherwise(a[c]).alias(c)
            return F.struct(opened("indent"), opened("delim"), block.alias("block"), rank.alias("rank"), x["lo"].alias("lo"), x["hi"].alias("hi"), x["cut"].alias("cut"), F.array_append(a["out"], mine).alias("out"))

        return bound(kind, after)

    return F.aggregate(items, start, step, lambda a: a["out"])


def _one_style(items: Column) -> Column:
    """R12's style: whether the first two neighbouring items of one list are both 1."""
    one = lambda x: T.has(x["num"], r"^0*1\z")
    pairs = F.zip_with(items, F.slice(items, F.lit(2), F.size(items)), lambda a, b: F.struct(((a["indent"] == b["indent"]) & (a["delim"] == b["delim"])).alias("pair"), (one(a) & one(b)).alias("ones")))
    first = F.get(F.filter(pairs, lambda p: F.coalesce(p["pair"], F.lit(False))), F.lit(0))
    return F.coalesce(first["ones"], F.lit(False))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's variable is not copied into its uses as a column's expression is."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ordered_list_prefix(lines: DataFrame) -> DataFrame:
    """R12 (S): renumber the items of blocks of two or more, 1 1 1 or 1 2 3 as the document's first list has it.

    A document's lines are gathered for the fold and spread again, where they are: the
    windows before have brought them together. Each item meets its place by its ordinal.
    """
    p = L.ORDERED_ITEM
    out = lines.withColumn("_item", ~F.col("skip") & T.has("line", p)).withColumn("_nth", F.sum(F.col("_item").cast("int")).over(L.upto()))
    gap = Window.partitionBy(L.KEY, "_nth")
    text = F.when(~F.col("_item") & ~L.blank() & ~F.col("skip"), F.col("line"))
    parts = {"indent": T.group("line", p, 1), "num": T.group("line", p, 2), "delim": T.group("line", p, 3), "lo": F.min(text).over(gap), "hi": F.max(text).over(gap), "cut": F.max((F.col("skip") & ~F.col("_item")).cast("int")).over(gap) == 1}
    kept = [c for c in lines.columns if c not in (L.KEY, "line_no")]
    out = out.select(L.KEY, "line_no", "_item", "_nth", *kept, F.when(F.col("_item"), F.struct(*(v.alias(k) for k, v in parts.items()))).alias("_parts"))
    packed = out.groupBy(L.KEY).agg(F.sort_array(F.collect_list(F.struct(*(c for c in out.columns if c != L.KEY)))).alias("_rows"))

    def placed(rows: Column) -> Column:
        items = F.transform(F.filter(rows, lambda r: r["_item"]), lambda r: F.struct(r["line"].alias("line"), *(r["_parts"][k].alias(k) for k in parts)))
        both = bound(items, lambda xs: F.struct(_list_fold(xs).alias("fold"), _one_style(xs).alias("one")))
        fields = ["line_no", *kept]
        return bound(both, lambda b: F.transform(rows, lambda r: F.struct(*(r[c].alias(c) for c in fields), F.when(r["_item"], F.get(b["fold"], r["_nth"] - 1)).alias("_place"), b["one"].alias("_one"))))

    spread = packed.select(L.KEY, F.explode(bound(F.col("_rows"), placed)).alias("_r")).select(L.KEY, "_r.*")
    rank, block = F.col("_place.rank"), F.col("_place.block")
    longest = F.max(rank).over(Window.partitionBy(L.KEY, block))
    want = F.when(F.col("_one"), F.lit("1")).otherwise(rank.cast("string"))
    due = (block > 0) & (longest > 1) & (F.regexp_replace(F.col("_place.num"), "^0+(?=.)", "") != want)
    spread = spread.withColumn("_want", F.when(due, want)).drop("_place", "_one")
    new = F.concat(T.group("line", p, 1), F.col("_want"), T.group("line", p, 3), T.group("line", p, 4), T.group("line", p, 5))
    return _counted(spread, "md029", F.col("_want").isNotNull(), new).drop("_want")


def _insert(lines: DataFrame, rule: str, above: Column, below: Column) -> DataFrame:
    """Put empty lines above and below the lines that ask for them; counted on the line that asks."""
    out = lines.withColumns({"_above": F.coalesce(above, F.lit(False)), "_below": F.coalesce(below, F.lit(False))})
    out = out.withColumn(f"n_{rule}", F.col("_above").cast("int") + F.col("_below").cast("int"))
    counts = [c for c in out.columns if c.startswith("n_")]
    here = F.array_compact(F.array(F.when(F.col("_above"), F.lit(0)), F.lit(1), F.when(F.col("_below"), F.lit(2))))
    out = out.withColumn("_sub", F.explode(here))
    real = F.col("_sub") == 1
    out = out.withColumns({"line": F.when(real, F.col("line")).otherwise("")} | {c: F.when(real, F.col(c)).otherwise(0) for c in counts})
    return L.renumber(out, "line_no", "_sub").drop("_above", "_below", "_sub")


def blanks_around_headings(lines: DataFrame) -> DataFrame:
    """R13 (S): a blank line above and below each heading."""
    head = ~F.col("skip") & T.has("line", L.HEADING)
    out = lines.withColumn("_head", head)
    above = F.col("_head") & L.needs_blank_before() & ~F.coalesce(L.before("_head"), F.lit(False))
    return _insert(out, "md022", above, F.col("_head") & L.needs_blank_after()).drop("_head")


def blanks_around_fences(lines: DataFrame) -> DataFrame:
    """A blank line above each opening and below each closing fence mark."""
    mark = T.has("line", L.FENCE)
    nth = F.sum(mark.cast("int")).over(L.upto())
    out = lines.withColumns({"_opens": mark & (nth % 2 == 1), "_closes": mark & (nth % 2 == 0)})
    above = F.col("_opens") & L.needs_blank_before() & ~F.coalesce(L.before("_closes"), F.lit(False))
    return _insert(out, "md031", above, F.col("_closes") & L.needs_blank_after()).drop("_opens", "_closes")


def blanks_around_lists(lines: DataFrame) -> DataFrame:
    """R15 (S): a blank line above and below each top-level list."""
    top = T.has("line", L.TOP_ITEM)
    stay = ~F.col("skip") & (T.has("line", L.LIST_ITEM) | T.has("line", r"^[ \t]") | (L.blank() & F.coalesce(L.after(top), F.lit(False))))
    out = lines.withColumns({"_stay": stay, "_start": ~F.col("skip") & top})
    out = out.withColumn("_seg", F.sum((~F.col("_stay")).cast("int")).over(L.upto()))
    seg = Window.partitionBy(L.KEY, "_seg").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("_in", F.col("_stay") & (F.max(F.col("_start").cast("int")).over(seg) == 1))
    out = out.withColumn("_was", F.coalesce(L.before("_in"), F.lit(False)))
    above = (F.col("_start") & ~F.col("_was") & L.needs_blank_before()) | (F.col("_was") & ~F.col("_in") & ~L.blank())
    return _insert(out, "md032", above, F.lit(False)).drop("_stay", "_start", "_seg", "_in", "_was")


def consecutive_blanks(lines: DataFrame) -> DataFrame:
    """R16 (S): runs of blank lines become one; dropped lines stay as rows with dead set."""
    quiet = L.blank() & ~F.col("skip")
    out = lines.withColumn("_quiet", quiet)
    dead = F.col("_quiet") & F.coalesce(L.before("_quiet"), F.lit(False))
    return out.withColumn("dead", dead).withColumn("n_md012", F.col("dead").cast("int")).drop("_quiet")


def final_newline(text: Column | str) -> Column:
    """Exactly one newline at the end; the empty text stays."""
    t = T.col(text)
    return F.when(t == "", t).otherwise(F.concat(F.regexp_replace(t, r"\n+\z", ""), F.lit("\n")))


#: The lint rules in order. The order is part of the result.
RULES: tuple[tuple[str, Pass], ...] = (
    ("formfeed", form_feeds),
    ("md010", hard_tabs),
    ("md025", title_in_front_matter),
    ("md009", trailing_white_space),
    ("md018", missing_hash_space),
    ("md026", heading_punctuation),
    ("md034", bare_urls),
    ("bullet", unicode_bullets),
    ("heading", numbered_headings),
    ("rejoin", list_continuations),
    ("callout", bare_callouts),
    ("md029", ordered_list_prefix),
    ("md022", blanks_around_headings),
    ("md031", blanks_around_fences),
    ("md032", blanks_around_lists),
    ("md012", consecutive_blanks),
)
#: After these rules the protected lines are found anew: they change which lines there are.
MOVES = {"formfeed", "rejoin", "md022", "md031", "md032"}
_STATE = ("in_fence", "fm_end", "skip")


def one_rule(lines: DataFrame, rule: str) -> DataFrame:
    """Apply one lint rule to lines: doc_id, line_no, line, n_<rule>; dropped lines are gone."""
    out = dict(RULES)[rule](L.with_skip(lines)).drop(*_STATE)
    return L.renumber(out.filter(~F.col("dead")).drop("dead")) if "dead" in out.columns else out


def lint_lines(lines: DataFrame) -> DataFrame:
    """R18 on lines: all rules but the last in order, with a count column for each."""
    out = L.with_skip(lines)
    for rule, apply in RULES:
        out = apply(out)
        if rule == "rejoin":
            out = L.renumber(out)
        if rule in MOVES:
            out = L.with_skip(out.drop(*_STATE))
    return out.drop(*_STATE)


def lint(docs: DataFrame) -> DataFrame:
    """doc_id, text cleaned by all rules, fixes (rule -> count, only those over 0). Null texts have no row."""
    rows = lint_lines(L.to_lines(docs))
    sums = [F.sum(f"n_{r}").cast("long").alias(r) for r, _ in RULES]
    live = F.array_sort(F.collect_list(F.when(~F.col("dead"), F.struct("line_no", "line"))))
    out = rows.groupBy(L.KEY).agg(F.array_join(F.transform(live, lambda r: r["line"]), "\n").alias("_text"), *sums)
    out = out.withColumn("text", final_newline("_text")).withColumn("md047", (F.col("text") != F.col("_text")).cast("long"))
    names = [r for r, _ in RULES] + ["md047"]
    fixes = F.map_filter(F.create_map(*(x for r in names for x in (F.lit(r), F.col(r)))), lambda k, v: v > 0)
    return out.select(L.KEY, "text", fixes.alias("fixes"))
