"""The bilingual lexicon of eye care and the expansion of queries by it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.functions.text import has_cjk, is_short_word, text_matches

# fixed values: terms and what they expand to, in the lexicon's order
TERMS: dict[str, list[str]] = {
    "白内障": ["cataract", "cataract surgery", "congenital cataract"],
    "近视": ["myopia", "high myopia"],
    "高度近视": ["high myopia"],
    "青光眼": ["glaucoma"],
    "老年黄斑变性": ["amd", "age-related macular degeneration"],
    "amd": ["老年黄斑变性", "age-related macular degeneration"],
    "糖尿病视网膜病变": ["diabetic retinopathy", "糖网", "dr"],
    "糖网": ["diabetic retinopathy", "糖尿病视网膜病变", "dr"],
    "dr": ["diabetic retinopathy", "糖尿病视网膜病变", "糖网"],
    "糖尿病黄斑水肿": ["dme", "diabetic macular edema"],
    "dme": ["糖尿病黄斑水肿", "diabetic macular edema"],
    "视网膜静脉阻塞": ["rvo", "retinal vein occlusion"],
    "rvo": ["视网膜静脉阻塞", "retinal vein occlusion"],
    "视网膜脱离": ["rd", "retinal detachment"],
    "rd": ["视网膜脱离", "retinal detachment"],
    "视网膜病变": ["retinopathy"],
    "视网膜": ["retina", "retinal"],
    "眼压": ["intraocular pressure"],
    "oct": ["光学相干断层扫描", "optical coherence tomography"],
    "光学相干断层扫描": ["oct", "optical coherence tomography"],
    "ffa": ["荧光素眼底血管造影", "fundus fluorescein angiography"],
    "荧光素眼底血管造影": ["ffa", "fundus fluorescein angiography"],
    "icg": ["吲哚菁绿血管造影", "indocyanine green angiography"],
    "icga": ["吲哚菁绿血管造影", "indocyanine green angiography"],
    "吲哚菁绿血管造影": ["icg", "icga", "indocyanine green angiography"],
    "黄斑前膜": ["erm", "epiretinal membrane"],
    "erm": ["黄斑前膜", "epiretinal membrane"],
    "黄斑裂孔": ["mh", "macular hole"],
    "mh": ["黄斑裂孔", "macular hole"],
    "中心性浆液性脉络膜视网膜病变": ["csc", "cscr", "central serous chorioretinopathy"],
    "csc": ["中心性浆液性脉络膜视网膜病变", "cscr", "central serous chorioretinopathy"],
    "cscr": ["中心性浆液性脉络膜视网膜病变", "csc", "central serous chorioretinopathy"],
    "早产儿视网膜病变": ["rop", "retinopathy of prematurity"],
    "rop": ["早产儿视网膜病变", "retinopathy of prematurity"],
    "原发性开角型青光眼": ["poag", "primary open-angle glaucoma"],
    "poag": ["原发性开角型青光眼", "primary open-angle glaucoma"],
    "原发性闭角型青光眼": ["pacg", "primary angle-closure glaucoma"],
    "pacg": ["原发性闭角型青光眼", "primary angle-closure glaucoma"],
    "干眼": ["dry eye", "dry eye disease", "干眼症", "ded"],
    "干眼症": ["dry eye", "dry eye disease", "干眼", "ded"],
    "ded": ["干眼", "干眼症", "dry eye disease"],
    "斜视": ["strabismus"],
    "弱视": ["amblyopia"],
    "角膜": ["cornea", "corneal"],
    "圆锥角膜": ["kc", "keratoconus"],
    "kc": ["圆锥角膜", "keratoconus"],
    "抗vegf": ["anti-vegf", "vascular endothelial growth factor inhibitor"],
    "anti-vegf": ["抗vegf", "vascular endothelial growth factor inhibitor"],
    "玻切": ["玻璃体切割术", "vitrectomy", "ppv"],
    "玻璃体切割术": ["玻切", "vitrectomy", "ppv"],
    "vitrectomy": ["玻切", "玻璃体切割术", "ppv"],
    "ppv": ["玻切", "玻璃体切割术", "vitrectomy"],
    "白内障超乳": ["phaco", "phacoemulsification"],
    "phaco": ["白内障超乳", "phacoemulsification"],
    "phacoemulsification": ["白内障超乳", "phaco"],
    "人工晶体": ["iol", "intraocular lens"],
    "iol": ["人工晶体", "intraocular lens"],
    "飞秒激光": ["femtosecond laser", "femto"],
    "femtosecond laser": ["飞秒激光", "femto"],
    "femto": ["飞秒激光", "femtosecond laser"],
    "smile": ["全飞秒", "small incision lenticule extraction"],
    "全飞秒": ["smile", "small incision lenticule extraction"],
    "lasik": ["准分子激光原位角膜磨镶术", "laser in situ keratomileusis"],
    "准分子激光原位角膜磨镶术": ["lasik", "laser in situ keratomileusis"],
    "眼底": ["fundus"],
    "人工智能": ["artificial intelligence"],
    "黄斑": ["macular"],
    "葡萄膜炎": ["uveitis"],
    "视力": ["visual acuity"],
    "屈光": ["refractive", "refraction"],
    "泪器病": ["lacrimal disease", "lacrimal", "nasolacrimal", "lacrimal duct"],
    "泪器": ["lacrimal", "nasolacrimal", "lacrimal duct"],
}


def shape(text: str) -> str:
    """cjk, phrase (more than four ASCII letters in all), short (one to four) or other."""
    if has_cjk(text):
        return "cjk"
    letters = sum(len(w) for w in re.findall("[A-Za-z]+(?:-[A-Za-z]+)?", text))
    return "phrase" if letters > 4 else "short" if letters else "other"


# fixed values: how much an expansion of each shape is preferred, by the kind of the query
PREFERENCE = {
    "short": {"phrase": 4, "cjk": 3, "short": 2},
    "cjk": {"phrase": 4, "short": 3, "cjk": 2},
    "latin": {"cjk": 3, "phrase": 2, "short": 1},
}


def expansions(query: str | None) -> list[str]:
    """What the lexicon offers for a query. First what the matching terms stand for, terms equal to the query and longer ones first; of each term what
    suits the query's script best. Then the terms that stand for something in the query."""
    q = (query or "").strip().lower()
    if not q:
        return []
    wanted = PREFERENCE["short" if is_short_word(q) else "cjk" if has_cjk(q) else "latin"]
    by_fit = lambda term: (term != q, -len(term))
    forward = sorted((t for t in TERMS if text_matches(q, t)), key=by_fit)
    backward = sorted((t for t, others in TERMS.items() if any(text_matches(q, o) for o in others)), key=by_fit)
    found = [x for t in forward for x in sorted(TERMS[t], key=lambda x: -wanted.get(shape(x), 0))]
    return list(dict.fromkeys(found + backward))


def lexicon(spark: SparkSession) -> DataFrame:
    """(term_no, term, expansion_no, expansion), both numbered from 1."""
    rows = [(i, t, j, x) for i, (t, others) in enumerate(TERMS.items(), 1) for j, x in enumerate(others, 1)]
    return spark.createDataFrame(rows, "term_no int, term string, expansion_no int, expansion string")


def expand_queries(queries: DataFrame, column: str) -> DataFrame:
    """The rows of queries with each term of the lexicon that the column holds and what it stands for. The lexicon is fixed and small; it is broadcast."""
    spark = queries.sparkSession
    q = F.lower(F.col(column))
    short = F.col("term").rlike("^[a-z]{1,4}$")
    alone = F.expr(f"regexp_like(lower(`{column}`), concat('(?<![a-z0-9])', term, '(?![a-z0-9])'))")
    return queries.join(F.broadcast(lexicon(spark)), F.when(short, alone).otherwise(q.contains(F.col("term"))))
