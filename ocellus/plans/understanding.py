"""Understanding a search query: years, authors, intent, rewriting. Plain Python on the driver; the results become literals in the plan."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from ocellus.functions.lexicon import expansions
from ocellus.functions.text import has_cjk, is_short_word
from ocellus.operators.retrieval import surname_in

# fixed values: words by which queries leave out or ask for authors, and for papers in general
LEAVE_OUT = "不要|不看|排除|去掉|剔除|过滤掉|不包括|不含|别要"
IS_NOT = r"(?:作者\s*)?(?:不是|非)"
ASK_FOR = "作者(?:是|为|:|：)?|只看|仅看|只要|包括|包含"
PAPERS = "文章|论文|文献|研究"
RELATED = "相关文章|相关论文|相关文献|相关研究"
EN_PAPERS = "papers?|articles?|studies?"
EN_LEAVE_OUT = "exclude|without|not"
EN_ASK_FOR = r"author\s*:?\s*|by\s+|include\s+"
HAN_NAME, LATIN_NAME = "[一-鿿]{2,6}", r"[A-Za-z][A-Za-z .'-]{1,40}"
TITLES_OF_PEOPLE = "教授|医生|主任|老师"
AUTHOR_WORDS = r"作者|教授|医生|医师|主任|院长|老师|by\s+|author\s*:?"
NUMERALS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
YEARS_BACK = r"(?:近|最近)\s*([一二两三四五六七八九十\d]+)\s*年"
COLLOQUIAL = ("怎么", "哪些", "有没有", "帮我", "想找", "推荐", "是什么", "关系", "相关", "最新", "经典", "how", "what", "which", "help me")
EDGE = " ,，。.;；:："
# fixed values: what makes a rewritten query worth trying: points by intent, words of the query that show it, words of the candidate that answer it
INTENTS = (
    (35.0, "手术|术后|术式|surgery|surgical|procedure|operative|operation", "surgery|surgical|procedure|operative|operation|phaco|phacoemulsification"),
    (20.0, "治疗|疗法|用药|management|treatment|therapy", "treatment|therapy|management|drug|medication"),
    (20.0, "诊断|筛查|检查|成像|oct|diagnos|screen|imaging", "diagnosis|diagnostic|screening|imaging|oct"),
)
FEW_HITS, MAX_REWRITES = 8, 2


@dataclass(frozen=True)
class Rewrite:
    """What an outside service suggests."""

    zh: tuple[str, ...] = ()
    en: tuple[str, ...] = ()
    must: tuple[str, ...] = ()


@dataclass
class Query:
    raw: str
    text: str
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    year_from: int | None = None
    year_to: int | None = None
    expansions: list[str] = field(default_factory=list)


def tidy(text: str) -> str:
    return " ".join(text.split()).strip(EDGE)


def distinct(items) -> list[str]:
    return list(dict.fromkeys(items))


def named(patterns: tuple[str, ...], text: str) -> list[str]:
    return [n for p in patterns for m in re.finditer(p, text, re.IGNORECASE) if (n := m.group(1).strip(EDGE))]


HAN_END = rf"(?:的(?:{PAPERS})|{PAPERS}|[,，;；。]|$)"
LATIN_END = rf"(?:\s+(?:{EN_PAPERS})|[,，;；.]|$)"


def excluded_authors(text: str) -> list[str]:
    """Names after words like "without". A name written in Chinese also ends at 作者 or 的, so 不要李伟作者的研究 leaves 李伟 out."""
    end = HAN_END.replace("(?:的", "(?:作者|的", 1)
    return distinct(named((rf"(?:{LEAVE_OUT})\s*({HAN_NAME}?){end}", rf"{IS_NOT}\s*({HAN_NAME}?){end}", rf"(?:{EN_LEAVE_OUT})\s+({LATIN_NAME}?){LATIN_END}"), text))


def included_authors(text: str, known: Callable[[str], bool]) -> list[str]:
    """Names that the query asks for and the corpus has."""
    patterns = (rf"(?:{ASK_FOR})\s*({HAN_NAME}?){HAN_END}", rf"({HAN_NAME}?)的(?:{PAPERS})", rf"^({HAN_NAME}?)的.*(?:{RELATED}|{PAPERS})", rf"(?:{EN_ASK_FOR})({LATIN_NAME}?){LATIN_END}")
    left_out = set(excluded_authors(text))
    names = (re.sub("^(?:只看|仅看|只要|包括|包含|作者是|作者为|作者)", "", n).strip() for n in named(patterns, text))
    return [n for n in distinct(names) if n and not re.match(f"(?:{LEAVE_OUT})", n) and n not in left_out and known(n)]


def without_exclusions(text: str) -> str:
    before, after = r"(?:[,，;；。]\s*)?", f"(?:作者)?(?:的)?(?:{PAPERS})?"
    names = [n for n in excluded_authors(text) if has_cjk(n)]
    for n in names:  # what was understood as a name goes, no more
        text = re.sub(rf"{before}(?:{LEAVE_OUT}|{IS_NOT})\s*{re.escape(n)}{after}", " ", text)
    if not names:
        for words in (LEAVE_OUT, IS_NOT):
            text = re.sub(rf"{before}(?:{words})\s*{HAN_NAME}{after}", " ", text)
    text = re.sub(rf"{before}(?:{EN_LEAVE_OUT})\s+{LATIN_NAME}(?:\s+(?:{EN_PAPERS}))?", " ", text, flags=re.IGNORECASE)
    return tidy(text)


def without_inclusions(text: str) -> str:
    before = r"(?:[,，;；。]\s*)?"
    text = re.sub(rf"{before}(?:{ASK_FOR})\s*{HAN_NAME}(?:的)?(?:{PAPERS})?", " ", text)
    text = re.sub(rf"{before}(?:{EN_ASK_FOR}){LATIN_NAME}(?:\s+(?:{EN_PAPERS}))?", " ", text, flags=re.IGNORECASE)
    return tidy(text)


def without_paper_words(text: str) -> str:
    text = re.sub(rf"(?:的)?(?:{RELATED}|{PAPERS})$", "", text)
    return tidy(re.sub(rf"\b(?:{EN_PAPERS}|literature)\b$", "", text, flags=re.IGNORECASE))


def years_in(text: str, year_from: int | None, year_to: int | None, today: date) -> tuple[int | None, int | None]:
    """Given bounds, else those that the query names: this year, last year, the last N years with the year at their beginning."""
    if year_from is not None or year_to is not None:
        return year_from, year_to
    now = today.year
    if "今年" in text:
        return now, now
    if "去年" in text:
        return now - 1, now - 1
    if m := re.search(YEARS_BACK, text):
        n = int(m.group(1)) if m.group(1).isdigit() else NUMERALS.get(m.group(1), 0)
        if n:
            return now - n, now
    return None, None


def parse(text: str | None, known: Callable[[str], bool] = lambda name: False, year_from: int | None = None, year_to: int | None = None, today: date | None = None) -> Query:
    """known: whether the corpus has an author."""
    raw = (text or "").strip()
    first, last = years_in(raw, year_from, year_to, today or date.today())
    rest = without_exclusions(raw)
    include = included_authors(rest, known)
    topic = without_inclusions(rest)
    topic = re.sub(f"今年|去年|{YEARS_BACK}", " ", topic)
    topic = tidy(without_paper_words(tidy(topic))) or raw
    return Query(raw, topic, include, excluded_authors(raw), first, last, expansions(topic))


def wants_author(q: Query, known: Callable[[str], bool]) -> bool:
    """Whether authors are searched as well."""
    raw = q.raw
    if q.include or q.exclude:
        return True
    if re.match(f"{HAN_NAME}的", raw) and re.search(f"{RELATED}|{PAPERS}|{TITLES_OF_PEOPLE}", raw):
        return True
    if surname_in(raw) or re.search(AUTHOR_WORDS, raw, re.IGNORECASE):
        return True
    if is_short_word(raw) and expansions(raw):
        return False
    return bool(raw) and len(raw) <= 24 and known(raw)


def author_query(q: Query) -> str:
    if q.include:
        return q.include[0]
    m = re.match(f"({HAN_NAME})的", q.raw)
    return m.group(1) if m else q.raw


def is_mixed(text: str) -> bool:
    return has_cjk(text) and bool(re.search("[A-Za-z]", text))


def is_colloquial(text: str) -> bool:
    low = text.strip().lower()
    return any(w in low for w in COLLOQUIAL) or "?" in low or "？" in low


def clean_candidate(raw: str, candidate: str | None) -> str:
    """A candidate that is worth searching, white space collapsed; else the empty string."""
    text = " ".join(str(candidate or "").split())
    words = re.findall("[A-Za-z]+(?:-[A-Za-z]+)?", text)
    if has_cjk(text):
        alone = sum("一" <= c <= "鿿" for c in text) < 2
        return "" if alone or (re.search("[A-Za-z]", text) and not is_mixed(raw)) else text
    return "" if len(words) == 1 and len(words[0]) <= 1 else text


def priority(raw: str, candidate: str) -> float:
    low = candidate.strip().lower()
    if not low:
        return -1.0
    words = re.findall(r"[a-z]+(?:-[a-z]+)?|\d+(?:\.\d+)?", low)
    score = min(len(words), 4) * 10 + min(len(low), 40) * 0.2
    if has_cjk(raw) and re.search("[a-z]", low):
        score += 8
    return score + sum(points for points, asks, answers in INTENTS if re.search(asks, raw, re.IGNORECASE) and re.search(rf"\b(?:{answers})\b", low))


def select(raw: str, candidates, limit: int = MAX_REWRITES) -> list[str]:
    """The `limit` best different candidates; of equal ones the earlier."""
    seen, kept = {raw.strip().lower()}, []
    for c in candidates:
        text = clean_candidate(raw, c)
        if text and text.lower() not in seen:
            seen.add(text.lower())
            kept.append(text)
    return sorted(kept, key=lambda t: -priority(raw, t))[: max(limit, 0)]


def is_english(text: str) -> bool:
    return bool(re.search("[A-Za-z]", text)) and not has_cjk(text)


# fixed values: where candidates come from (the lexicon or parts of a suggestion), for queries of which scripts, and which of them
OFFERS = (
    ("en", {"han", "mixed"}, slice(None)),
    ("lexicon", {"han", "mixed", "latin", "other"}, slice(2)),
    ("en", {"latin", "other"}, slice(2)),
    ("zh", {"latin", "mixed"}, slice(1)),
    ("must", {"latin", "other"}, slice(1)),
    ("zh", {"han", "mixed", "latin", "other"}, slice(1, 2)),
)


def script_of(text: str) -> str:
    latin = bool(re.search("[A-Za-z]", text))
    return ("mixed" if latin else "han") if has_cjk(text) else "latin" if latin else "other"


def rewrites(raw: str, rewrite: Rewrite | None) -> list[str]:
    """At most MAX_REWRITES rewritten queries. Without a suggestion they are the lexicon's; with one the best of what OFFERS name for the query's script. Of a query with
    Chinese the first English candidate leads, whatever its priority."""
    origins = {"lexicon": expansions(raw)} | ({"en": rewrite.en, "zh": rewrite.zh, "must": rewrite.must} if rewrite else {})
    if rewrite is None:
        return select(raw, origins["lexicon"])
    script = script_of(raw)
    offered = [c for origin, scripts, part in OFFERS if script in scripts for c in origins[origin][part]]
    english = (clean_candidate(raw, c) for origin in ("en", "lexicon") for c in origins[origin])
    lead = [c for c in itertools.islice(filter(is_english, english), 1) if script in ("han", "mixed")]
    return lead + select(raw, [c for c in offered if str(c).strip().lower() not in map(str.lower, lead)], MAX_REWRITES - len(lead))


def always_expands(text: str) -> bool:
    """Whether a query is rewritten whatever it finds by itself."""
    q = text.strip()
    words = re.findall(r"\w+", q)
    return has_cjk(q) or len(words) <= 2 or len(q) <= 8 or is_mixed(q) or is_colloquial(q)


def rewrite_limit(text: str) -> int:
    return 1 if has_cjk(text) else MAX_REWRITES


def json_object(text: str | None) -> dict | None:
    """The JSON object that a text is, or holds between its first and last brace."""
    t = (text or "").strip()
    for part in (t, t[t.find("{") : t.rfind("}") + 1] if "{" in t else ""):
        try:
            if isinstance(found := json.loads(part), dict):
                return found
        except ValueError:
            continue
    return None
