"""Diagram blocks of a cell, their syntax type and file names, and asset name matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgauge.functions.text import WORD, WS, fence, let, strip
from quillgauge.operators.skew import even_join

SEPARATOR = "/"
SYNTAX_TYPES = ("activity-legacy", "activity-modern", "unknown")


def blocks(cell: Column) -> Column:
    """All tagged blocks of a cell; without any, the text itself, tagged unless it begins or
    ends with a tag; none for a blank cell."""
    none = F.array().cast("array<string>")
    tagged = F.regexp_extract_all(
        cell, F.lit(f"(?is)(@startuml(?![{WORD}]).*?@enduml(?![{WORD}]))"), F.lit(1)
    )

    def alone(text: Column) -> Column:
        has_tag = F.startswith(F.lower(text), F.lit("@startuml")) | F.endswith(F.lower(text), F.lit("@enduml"))
        return F.when(text == "", none).otherwise(
            F.array(F.when(has_tag, text).otherwise(F.concat(F.lit("@startuml\n"), text, F.lit("\n@enduml\n"))))
        )

    return let(tagged, lambda found: F.when(F.size(found) > 0, found).otherwise(let(strip(cell), alone)))


def syntax_type(block: Column) -> Column:
    """``activity-legacy`` or ``activity-modern``, the higher score wins; else ``unknown``."""

    def has(text: Column, word: str) -> Column:
        return F.contains(text, F.lit(word))

    def decide(text: Column) -> Column:
        def keyword_line(word: str) -> Column:
            return F.rlike(text, F.lit(f"\\n[{WS}]*{word}[{WS}]*\\n"))

        def points(test: Column, worth: int) -> Column:
            return F.when(test, worth).otherwise(0)

        legacy = (
            points(keyword_line("start"), 2)
            + points(keyword_line("stop"), 2)
            + points(F.rlike(text, F.lit(f":[^:\\n]+;[{WS}]*\\n")), 1)
            + points(has(text, "partition "), 1)
        )
        condition = F.rlike(text, F.lit(f"(?<![{WORD}])if[{WS}]*\\([^)]+?\\)[{WS}]*then(?![{WORD}])"))
        modern = (
            points(has(text, "endif") & condition, 2)
            + points(has(text, "repeat") & has(text, "while"), 2)
            + points(has(text, "fork") & (has(text, "end fork") | has(text, "endfork")), 2)
            + points(has(text, "switch") & has(text, "endswitch"), 2)
        )
        return let(
            F.struct(legacy.alias("l"), modern.alias("m")),
            lambda s: F.when(s["m"] > s["l"], "activity-modern").when(s["l"] > s["m"], "activity-legacy").otherwise("unknown"),
        )

    return F.when(F.coalesce(block, F.lit("")) == "", "unknown").otherwise(
        let(F.concat(F.lit("\n"), F.lower(block), F.lit("\n")), decide)
    )


def unique_name(row: Column, index: Column, block: Column) -> Column:
    """``Row<r>[_D<i>]_<first six of the md5>``."""
    return F.concat(
        F.lit("Row"), row, F.when(index > 1, F.concat(F.lit("_D"), index)).otherwise(""), F.lit("_"),
        F.substring(F.md5(block), 1, 6),
    )


def safe_name(text: Column, longest: int = 50) -> Column:
    """Letters, digits, dot, dash and single underscores, at most ``longest``, never empty."""
    cleaned = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), "_+", "_")
    return let(
        F.btrim(F.substring(cleaned, 1, longest), F.lit("_")),
        lambda name: F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(name),
    )


def manifest(cells: DataFrame, root: str = "jpg") -> DataFrame:
    """One row per block of long cells (sheet, row_index, col_index, column_name, cell).

    Blank cells are skipped; the target path is ``root/<safe column>/<unique name>.jpg``. Where
    shortened column names would give one path twice, later blocks get a number.
    """
    text = strip(F.coalesce(F.col("cell"), F.lit("")))
    filled = fence(cells, {"cell": text}).filter(F.col("cell") != "")
    rows = filled.select(
        "sheet", "row_index", "col_index", "column_name", F.posexplode(blocks(F.col("cell"))).alias("_i", "block")
    ).withColumn("diagram_index", F.col("_i") + 1)
    name = unique_name(F.col("row_index"), F.col("diagram_index"), F.col("block"))
    path = F.concat(F.lit(root + SEPARATOR), safe_name(F.col("column_name")), F.lit(SEPARATOR), name)
    same = Window.partitionBy("_path").orderBy("sheet", "col_index", "row_index", "diagram_index")
    named = rows.withColumn("_path", path).withColumn("_times", F.row_number().over(same))
    number = F.when(F.col("_times") > 1, F.concat(F.lit("_"), F.col("_times"))).otherwise("")
    return named.select(
        "sheet", "row_index", "col_index", "column_name", "diagram_index", "block",
        syntax_type(F.col("block")).alias("syntax"), F.concat("_path", number, F.lit(".jpg")).alias("file_name"),
    )


def wide_cells(wide: DataFrame, row_index: str, columns: list[str], sheet: str) -> DataFrame:
    """Wide sheet -> cells with 1-based column positions."""
    positions = F.create_map(*[x for i, c in enumerate(columns, 1) for x in (F.lit(c), F.lit(i))])
    long = wide.unpivot([row_index], columns, "column_name", "cell")
    return long.select(
        F.lit(sheet).alias("sheet"), F.col(row_index).alias("row_index"),
        F.element_at(positions, F.col("column_name")).alias("col_index"), "column_name", "cell",
    )


def cell_counts(cells: DataFrame) -> DataFrame:
    """Cells, cells with content, diagrams, distinct columns used, in one pass over the cells."""
    text = fence(cells.select("column_name", strip(F.coalesce(F.col("cell"), F.lit(""))).alias("_t")), {"_n": F.when(F.col("_t") != "", F.size(blocks(F.col("_t"))))})
    # column names are few: they are counted first, so no distinct count over the cells is needed
    by_column = text.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("cells"), F.count("_n").alias("filled"), F.coalesce(F.sum("_n"), F.lit(0)).alias("diagrams")
    )
    return by_column.agg(
        F.coalesce(F.sum("cells"), F.lit(0)).alias("total_cells"), F.coalesce(F.sum("filled"), F.lit(0)).alias("cells_with_content"),
        F.coalesce(F.sum("diagrams"), F.lit(0)).alias("total_diagrams"), F.count(F.when(F.col("diagrams") > 0, F.col("column_name"))).alias("column_folders"),
    )


# --- assets ----------------------------------------------------------------------------


def asset_names(paths: DataFrame, path: str = "path", extensions: tuple[str, ...] = ("jpg", "jpeg"),
                skip: tuple[str, ...] = ()) -> DataFrame:
    """Folder and file name of the paths with one of the extensions, without skipped folders."""
    wanted = "|".join(extensions)
    split = paths.select(
        "*",
        F.regexp_extract(path, r"([^/\\]*)[/\\][^/\\]+$", 1).alias("folder"),
        F.regexp_extract(path, r"([^/\\]+)$", 1).alias("file"),
    )
    kept = split.filter(F.rlike("file", F.lit(rf"(?i)\.({wanted})$")))
    return kept.filter(~F.col("folder").isin(*skip)) if skip else kept


def match_prefix(files: DataFrame, stems: DataFrame, exact: bool = False, existing: DataFrame | None = None) -> DataFrame:
    """Each stem with every file whose name starts with it: (stem, folder, file, target).

    A file offers its prefixes of the lengths that occur among the stems, so the match is an
    equality join; prefixes that very many files share are salted by file name. ``exact`` asks
    for the whole token before the first underscore or the extension. Targets already in
    ``existing`` (stem, target) are left out.
    """
    unique = stems.select("stem").filter(F.col("stem") != "").distinct()
    if exact:
        offered = files.withColumn("stem", F.regexp_extract("file", r"^([^_.]+)", 1))
    else:
        # at most one length per possible file-name length
        lengths = unique.select(F.length("stem").alias("n")).distinct().agg(F.array_sort(F.collect_list("n")).alias("l")).scalar()
        offered = (
            files.withColumn("_n", F.explode(lengths)).filter(F.col("_n") <= F.length("file"))
            .withColumn("stem", F.substr(F.col("file"), F.lit(1), F.col("_n"))).drop("_n")
        )
    # the offers are many times what Spark reckons from the files; a semi join never broadcasts its left side
    found = even_join(offered, unique, ["stem"], F.struct("folder", "file"), how="left_semi").select(
        "stem", "folder", "file", F.concat_ws(" ", "folder", "file").alias("target")
    )
    return found if existing is None else found.join(existing, ["stem", "target"], "left_anti")
