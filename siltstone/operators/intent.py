"""Questions to intents, parameters and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_block, strip
from .extraction import with_retries

# Patterns of the intents, of the template rules and of parameters.
INTENTS = {
    "list_pollutants_by_standard": [r"(GB|HJ|DB)\s*\d+", r"标准.*?(限值|浓度|排放)", r"排放限值"],
    "list_articles_about_pollutant": [r"(SO2|NOx|PM2\.5|PM10|VOCs|COD|氨氮|总磷|危险废物|危废)", r"(大气|水|土壤).{0,5}(污染|防治)"],
    "find_similar_cases": [r"(类似|相似).*?(案例|案件|判例)", r"案[例例]", r"参考"],
    "lookup_penalty_for_violation": [r"(处罚|罚|刑)", r"(超标|违法).*?(罚款|拘留|停产)"],
    "lookup_article_content": [r"第[一二三四五六七八九十百千零〇0-9]+条", r"(说什么|怎么规定|怎么罚|怎么处罚)"],
    "case_sop": [r"核查流程|SOP|怎么办|怎么查|如何处置"],
    "industry_compliance": [r"(钢铁|化工|印染|造纸|火电|水泥|制药).*?(合规|标准|要求)"],
}
FALLBACK = "semantic_fallback"
MATCH_ALL = "MATCH (n) RETURN n LIMIT 10"
STD_ID = r"(?i)((?:GB|HJ|DB)\s*[\d\-—]+)"
ARTICLE_NO = r"第([一二三四五六七八九十百千零〇0-9]+)条"
RULES = [
    ("standard_pollutants", r"(?:GB|HJ|DB)\s*[\d\-—]+|标准.*?(限值|污染物|排放)", "std_id"),
    ("pollutant_articles", r"(SO2|NOx|PM2\.5|PM10|VOCs|COD|NH3-N|危废|危险废物)", "pollutant"),
    ("industry_standards", r"(钢铁|化工|印染|造纸|火电|水泥|制药|石化|焦化|有色|电镀|电池|畜禽)", "industry"),
    ("cases", r"(案件|案例|参考|类似)", "keyword"),
    ("article", r"第[一二三四五六七八九十百千零〇0-9]+条", "article_no"),
    ("penalty", r"(处罚|罚|刑|拘留|罚款)", "penalty_keyword"),
    ("violation", r"(违法|违规|超标|偷排)", "violation_keyword"),
]
POLLUTANTS = r"(?i)(SO2|NOx|PM2\.5|PM10|VOCs|COD|氨氮|NH3-N|危险废物|危废|总磷|总氮)"
INTENT_POLLUTANTS = r"(?i)(SO2|NOx|PM2\.5|PM10|VOCs|COD|氨氮|总磷|危险废物|危废)"
MENTIONS = r"(?i)(SO2|NOx|PM2\.5|PM10|VOCs|COD|氨氮|总磷|总氮|危险废物|HW|O3|TSP)"
INDUSTRIES = r"(钢铁|化工|印染|造纸|火电|水泥|制药|石化|焦化|有色|电镀|电池|畜禽|玻璃|陶瓷|纺织)"
INTENT_INDUSTRIES = r"(钢铁|化工|印染|造纸|火电|水泥|制药|石化|焦化|冶炼)"
PENALTIES = r"(罚款|拘留|停产|吊销|查封|责令)"
VIOLATIONS = r"(超标|偷排|违法|违规|未批先建|未取得|无证|数据造假|伪造|篡改)"


def found(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def hits(c: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur, whatever the case of letters."""
    out = F.lit(0)
    for p in patterns:
        out = out + F.coalesce(c.rlike("(?i)" + p), F.lit(False)).cast("int")
    return out


def route(questions: DataFrame, intents: dict[str, list[str]] | None = None) -> DataFrame:
    """(qid, intent, score, rank from 0): intents by number of patterns that hit, then by
    name, both falling; a question without any has the fallback."""
    table = intents or INTENTS
    scores = F.array(*[F.struct(hits(F.col("text"), p).alias("score"), F.lit(name).alias("intent")) for name, p in table.items()])
    ranked = F.sort_array(F.filter(scores, lambda x: x["score"] > 0), asc=False)
    ranked = F.when(F.size(ranked) > 0, ranked).otherwise(F.array(F.struct(F.lit(0).alias("score"), F.lit(FALLBACK).alias("intent"))))
    return questions.select("qid", F.posexplode(ranked).alias("rank", "r")).select("qid", "r.intent", F.col("r.score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


def article_no(c: Column) -> Column:
    n = found(c, ARTICLE_NO)
    return F.when(n.isNotNull(), F.concat(F.lit("第"), n, F.lit("条")))


def std_id(c: Column) -> Column:
    return F.replace(found(c, STD_ID), F.lit(" "), F.lit(""))


def params(c: Column) -> Column:
    """All parameters of a question; keyword only if there is no other."""
    own = {"std_id": std_id(c), "pollutant": found(c, POLLUTANTS), "industry": found(c, INDUSTRIES), "article_no": article_no(c), "penalty_keyword": found(c, PENALTIES), "violation_keyword": found(c, VIOLATIONS)}
    none = F.coalesce(*own.values()).isNull()
    return F.struct(*[v.alias(k) for k, v in own.items()], F.when(none, F.left(c, F.lit(30))).alias("keyword"))


def intent_params(c: Column, intent: Column) -> Column:
    """The parameters that an intent's template takes."""
    t = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), v)])
    made = {
        "list_pollutants_by_standard": (std_id(c), t(std_id=std_id(c))),
        "list_articles_about_pollutant": (found(c, INTENT_POLLUTANTS), t(pollutant=found(c, INTENT_POLLUTANTS))),
        "lookup_article_content": (article_no(c), t(article_no=article_no(c), doc_keyword=c)),
        "industry_compliance": (found(c, INTENT_INDUSTRIES), t(industry=found(c, INTENT_INDUSTRIES))),
        "find_similar_cases": (c, t(case_type=c, vio_keyword=c)),
    }
    out = F.lit(None).cast("map<string,string>")
    for name, (needed, value) in made.items():
        out = F.when((intent == name) & needed.isNotNull(), value).otherwise(out)
    return out


def match_template(c: Column) -> Column:
    """The first rule whose pattern occurs and whose parameter the question gives."""
    have = params(c)
    return F.coalesce(*[F.when(c.rlike("(?i)" + pattern) & (F.length(have[needs]) > 0), F.lit(name)) for name, pattern, needs in RULES])


def query_prompt(question: str, schema: str) -> str:
    """What a model is asked for a query, in this library's own words."""
    return f"图数据库的标签与关系如下：\n{schema}\n\n把下面的问题写成一条 Cypher 查询：\n{question}\n\n只输出 JSON，形如 {{\"cypher\": 查询, \"params\": {{参数名: 值}}}}，放在 ```json 代码块里；值一律走参数；可缺的部分用 OPTIONAL MATCH；最多 20 行。"


def text_to_query(questions: DataFrame, model=None, schema: str = "", tries: int = 1) -> DataFrame:
    """(qid, method, template, params): a template, else the model's query for the question
    and the schema, else match-all. The model may answer in JSON (cypher, params) or with the
    bare query; one that fails has not answered."""
    rows = questions.withColumn("template", match_template(F.col("text")))
    none = F.lit(None).cast("map<string,string>")
    given = F.from_json(F.to_json(params(F.col("text"))), "map<string,string>")
    if model is None:
        return rows.select("qid", F.when(F.col("template").isNull(), "fallback").otherwise("template").alias("method"), F.coalesce("template", F.lit(MATCH_ALL)).alias("template"), F.when(F.col("template").isNotNull(), given).otherwise(none).alias("params"))
    ask = with_retries(model, tries)
    missing = rows.filter("template is null").select("qid", "text")
    answers = missing.mapInPandas(lambda frames: (f.assign(answer=[ask(query_prompt(t, schema)) for t in f["text"]])[["qid", "answer"]] for f in frames), "qid long, answer string")
    made = F.from_json(json_block(F.col("answer")), "cypher string, params map<string,string>")
    bare = F.nullif(strip(F.regexp_replace("answer", r"```(?:cypher|json)?", "")), F.lit(""))
    joined = rows.join(answers, "qid", "left").withColumn("j", made).withColumn("q", F.coalesce(F.nullif(F.col("j.cypher"), F.lit("")), F.when(~F.coalesce(F.startswith(bare, F.lit("{")), F.lit(False)), bare)))
    has = F.col("template").isNotNull()
    return joined.select("qid", F.when(has, "template").when(F.col("q").isNotNull(), "model").otherwise("fallback").alias("method"), F.coalesce("template", "q", F.lit(MATCH_ALL)).alias("template"), F.when(has, given).when(F.col("q").isNotNull(), F.col("j.params")).otherwise(none).alias("params"))


def mentions(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(MENTIONS), F.lit(1)))


