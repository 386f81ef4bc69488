"""The driver tables in the shapes the operators work on, in both SQL dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from checks.registry import table

V_DIAGRAMS = """
select doc_id as story_id, upper(lang) as model_group, source as variant,
  array_to_string(list_concat(list_concat(
    case when doc_id % 5 = 0 then ['@startuml'] else ['@startuml', 'start'] end,
    list_transform(string_split(text, chr(10)), lambda x, j: case (doc_id + j - 1) % 16
      when 0 then concat('if (', x, ') then (yes)') when 1 then 'endif'
      when 4 then 'fork' when 6 then 'end fork'
      when 8 then concat('|Lane ', cast(j - 1 as varchar), '|') when 10 then 'note right'
      when 12 then concat('switch (', x, ')') when 14 then '-> next;'
      else concat(':', x, ';') end)),
    case when doc_id % 4 = 0 then ['@enduml'] else ['stop', '@enduml'] end), chr(10)) as code
from documents
"""
V_STORIES = "select conv_id as story_id, text as prompt from conversations where turn = 0"
V_VARIANTS = """
select conv_id as story_id, upper(substr(role, 1, 3)) as model_group,
  concat(upper(substr(role, 1, 3)), lpad(cast(turn as varchar(10)), 3, '0')) as variant, text as code
from conversations
"""
V_FEATURES = """
select c_mktsegment as feature, substr(c_mktsegment, 1, 3) as grp,
  case when c_custkey % 20 = 0 then null else c_acctbal end as value
from customer
"""
V_SCORES = "select p_partkey as id, p_retailprice as score from part"
# Six embeddings form one story, three of each of two groups: pairs grow with the table.
V_VECTORS = """
select vec_id // 6 as story_id, case when vec_id % 6 < 3 then 'ABA' else 'ABB' end as model_group,
  concat(case when vec_id % 6 < 3 then 'ABA' else 'ABB' end, lpad(cast(vec_id % 6 as varchar), 3, '0')) as variant,
  embedding
from embeddings
"""
V_FILES = """
select p_brand as folder, concat('Row', p_partkey, '_', substr(md5(p_name), 1, 6), '.jpg') as file from part
"""
V_STEMS = "select concat('Row', s_suppkey) as stem from supplier"
# Block cells: the code twice with a plain line between, raw text without tags, or the code.
V_CELLS = f"""
select d.story_id, d.variant, case when d.story_id % 7 = 0 then t.text
  when d.story_id % 3 = 0 then concat(d.code, chr(10), 'in between', chr(10), d.code) else d.code end as cell
from ({V_DIAGRAMS}) d join documents t on t.doc_id = d.story_id
"""


DIAGRAM_CODE = r"""array_join(concat(
            if(doc_id % 5 = 0, array('@startuml'), array('@startuml', 'start')),
            transform(split(text, '\n', -1), (x, i) -> case (doc_id + i) % 16
              when 0 then concat('if (', x, ') then (yes)') when 1 then 'endif'
              when 4 then 'fork' when 6 then 'end fork'
              when 8 then concat('|Lane ', cast(i as string), '|') when 10 then 'note right'
              when 12 then concat('switch (', x, ')') when 14 then '-> next;'
              else concat(':', x, ';') end),
            if(doc_id % 4 = 0, array('@enduml'), array('stop', '@enduml'))), '\n') as code"""


def diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as story_id",
        "upper(lang) as model_group",
        "source as variant",
        DIAGRAM_CODE,
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("turn = 0").selectExpr("conv_id as story_id", "text as prompt")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id as story_id",
        "upper(substr(role, 1, 3)) as model_group",
        "concat(upper(substr(role, 1, 3)), lpad(cast(turn as string), 3, '0')) as variant",
        "text as code",
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_mktsegment as feature",
        "substr(c_mktsegment, 1, 3) as grp",
        "case when c_custkey % 20 = 0 then null else c_acctbal end as value",
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_retailprice as score")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = "case when vec_id % 6 < 3 then 'ABA' else 'ABB' end"
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id div 6 as story_id",
        f"{group} as model_group",
        f"concat({group}, lpad(cast(vec_id % 6 as string), 3, '0')) as variant",
        "embedding",
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_brand as folder", "concat('Row', p_partkey, '_', substr(md5(p_name), 1, 6), '.jpg') as file"
    )


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("concat('Row', s_suppkey) as stem")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block cells of the diagram view, without joining back to the documents."""
    return (
        table(spark, sf_dir, "documents")
        .selectExpr("doc_id as story_id", "source as variant", "text", DIAGRAM_CODE)
        .selectExpr(
            "story_id",
            "variant",
            r"case when story_id % 7 = 0 then text "
            r"when story_id % 3 = 0 then concat(code, '\nin between\n', code) else code end as cell",
        )
    )
