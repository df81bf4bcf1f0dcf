"""Variant spellings of names, resolved by merging and matching again.

Each distinct string becomes a record with features: Han spelling, full name in any order, initials, formal given
name, words of a group and its acronym, and spellings one typing error away. Records that share a feature are merged when nothing
contradicts; a merged profile has the spellings and initials of all its members, enters blocking anew, and so on until
no further merge occurs. Features that only hint (initials, nicknames, acronyms, typing errors) join a weak profile to a
strong one if there is exactly one to which they lead.

Which tokens are surnames, syllables or given names is learnt from the strings themselves by counting.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.storage import cut_lineage, release

# fixed values: characters of names in traditional or variant form, each followed by the simplified one
VARIANTS = (
    "蘭兰顏颜淸清寧宁謙谦澤泽嵐岚駿骏賡赓傑杰華华國国張张陳陈劉刘趙赵黃黄吳吴孫孙馬马許许鄭郑謝谢馮冯蕭萧鄧邓葉叶閻阎譚谭鄒邹陸陆範范龔龚顧顾賴赖龍龙萬万錢钱湯汤喬乔賀贺莊庄嚴严龐庞紀纪項项陽阳魯鲁韋韦兪俞鮑鲍饒饶龜龟麥麦愛爱寶宝賓宾長长潔洁東东"
    "鳳凤剛刚廣广貴贵漢汉鴻鸿輝辉錦锦靜静軍军凱凯恆恒樂乐麗丽連连蓮莲靈灵鈴铃倫伦羅罗夢梦銘铭鳴鸣慶庆瓊琼榮荣潤润聖圣詩诗書书樹树順顺濤涛韜韬維维衛卫聞闻曉晓賢贤興兴勳勋雲云遠远澐沄禎祯貞贞楨桢鎮镇錚铮鐘钟鍾钟眞真瑩莹穎颖淵渊億亿藝艺義义優优語语"
    "園园悅悦筆笔銳锐葦苇偉伟煒炜緯纬"
    "峯峰勗勖愷恺遊游澂澄竇窦鈺钰駱骆栢柏淩凌蘇苏關关韓韩飛飞鵬鹏"
)
SIMPLE = {ord(a): b for a, b in zip(VARIANTS[::2], VARIANTS[1::2], strict=True)}
# fixed values: nicknames, each followed by the formal names it may stand for
NICKNAMES = {
    "tilly": "ottilie matilda", "vicky": "victoria", "vic": "victor victoria", "hank": "henry", "harry": "henry harold", "hans": "johannes johann", "gabi": "gabriella gabriele", "gaby": "gabriella", "peggy": "margaret", "maggie": "margaret", "meg": "margaret",
    "bill": "william", "billy": "william", "will": "william", "len": "leonard", "leo": "leonard", "kate": "katherine catherine", "katie": "katherine", "kathy": "katherine catherine", "ted": "edward theodore", "ed": "edward edwin", "eddie": "edward", "ned": "edward", "nick": "nicholas",
    "trish": "patricia", "pat": "patricia patrick", "patty": "patricia", "tony": "anthony antonio", "sue": "susannah susan", "susie": "susannah susan", "dora": "theodora dorothea isadora", "thea": "theodora dorothea", "bob": "robert", "rob": "robert", "bobby": "robert", "uschi": "ursula", "dot": "dorothy", "dottie": "dorothy", "dolly": "dorothy",
    "nacho": "ignacio", "yoli": "yolanda", "fred": "frederick alfred", "freddy": "frederick", "zach": "zachary", "zack": "zachary", "dick": "richard", "rick": "richard", "rich": "richard", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lisa": "elizabeth", "eliza": "elizabeth",
    "alex": "alexander alexandra", "andy": "andrew", "ben": "benjamin", "charlie": "charles", "chris": "christopher christine", "dan": "daniel", "dave": "david", "don": "donald", "frank": "francis franklin", "greg": "gregory", "jack": "john", "jim": "james", "jimmy": "james", "joe": "joseph", "jon": "jonathan", "ken": "kenneth", "larry": "lawrence",
    "matt": "matthew", "mike": "michael", "pepe": "jose", "paco": "francisco", "pete": "peter", "phil": "philip", "ray": "raymond", "ron": "ronald", "sam": "samuel samantha", "sandy": "alexander sandra", "steve": "stephen steven", "tim": "timothy", "tom": "thomas", "nell": "eleanor helen", "nora": "eleanor", "molly": "mary", "polly": "mary", "jenny": "jennifer", "debbie": "deborah", "becky": "rebecca", "cathy": "catherine", "cindy": "cynthia", "mandy": "amanda", "penny": "penelope", "toni": "antonia", "willi": "wilhelm", "fritz": "friedrich", "heinz": "heinrich", "sepp": "josef", "resi": "theresia", "lena": "helena magdalena", "lola": "dolores", "manolo": "manuel", "chema": "josemaria", "ze": "jose", "chico": "francisco", "tito": "roberto",
}
TITLES = {"dr", "prof", "professor", "md", "phd", "msc", "mr", "mrs", "ms", "pd", "med", "bsc", "jr", "sr"}
GROUP = re.compile(r"(?i)\b(study gro?u?p|group|grp|investigators|consortium|collaborators|collaboration|committee|working party|team)\b")
GROUP_WORDS = {"the", "of", "study", "group", "grp", "investigators", "collaborators", "collaboration", "committee", "for", "and"}
HAN = r"㐀-鿿"
SHORT_SURNAMES = set("xu li ni fu lu ye gu he ji si yi ma wu yu hu du ge ke mo qi su xi bi an ai bo".split())  # fixed values: two letters, so capitals may be one of these or initials


def plain(text: str) -> str:
    """Lower case without accents."""
    x = text.lower().replace("ø", "o").replace("æ", "ae").replace("œ", "oe").replace("ß", "ss").replace("ł", "l").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))


def fold(text: str) -> str:
    """plain() with ae, oe and ue before a consonant as the plain vowel, unless the word is made of romanised Chinese syllables."""
    x = plain(text)
    return x if splits(x.replace("-", ""), SYLLABLES, 3) else re.sub(r"(?<=[a-z])([aou])e(?=[bcdfghjklmnpqrstvwxz])", r"\1", x)


@dataclass
class Name:
    kind: str = "person"
    han: str = ""
    tokens: list[str] = field(default_factory=list)  # folded; hyphened or loose syllables in parts
    plain: list[str] = field(default_factory=list)  # the same without folding ae, oe and ue, which a typing error may have made
    upper: list[bool] = field(default_factory=list)
    initials: str = ""
    surname_first: bool = False
    acronym: str = ""


def parse(text: str) -> Name:
    out = Name()
    x = unicodedata.normalize("NFKC", text)
    x = re.sub(r"[#*†‡§]", " ", x)
    if GROUP.search(x):
        out.kind = "group"
        if m := re.search(r"\(([A-Z]{2,})\)", x):
            out.acronym = m.group(1)
            x = x.replace(m.group(0), " ")
        words = [w for w in re.findall(r"[^\W\d_]+\.?", x) if fold(w.rstrip(".")) not in GROUP_WORDS]
        if len(words) == 1 and words[0].isupper():
            out.acronym = words[0]
        else:
            out.tokens = [fold(w.rstrip(".")) for w in words]
        return out
    if m := re.search(rf"\(?\s*([{HAN}][{HAN}\s·]*)\)?", x):
        out.han = re.sub(r"[\s·]", "", m.group(1)).translate(SIMPLE)
        out.surname_first = m.start() == 0 and len(m.group(0)) < len(x)
        x = x.replace(m.group(0), " ")
    parts = [w for w in re.split(r"[\s,]+", x) if w]
    untitled = [w for w in parts if fold(w).strip(".") not in TITLES]
    if len(untitled) == 1 and len(parts) == 2 and not out.han and re.fullmatch("[A-Z]{2}", parts[1]):
        untitled = parts  # a surname alone has no title: these are initials
    parts = untitled
    for w in parts:
        letters = re.sub(r"[^\w-]", "", w).replace("_", "")
        dotted = re.fullmatch(r"(?:[^\W\d_]\.-?)+", w)
        single = len(letters) == 1
        caps = re.fullmatch(r"[A-Z]-?[A-Z]", letters) and len(parts) > 1 and (w is parts[-1] or "-" in letters) and letters.lower() not in SHORT_SURNAMES
        if dotted or single or caps:
            out.initials += re.sub(r"[^a-z]", "", fold(w))
        elif letters:
            out.tokens.append(fold(letters))
            out.plain.append(plain(letters))
            out.upper.append(letters.isupper())
    return out


def pairs_of(n: Name) -> list[tuple[str, str]]:
    """(given, surname) as the string may be read; syllables of a given name may stand apart or be joined by a hyphen."""
    t = [x for x in n.tokens if x]
    if not t:
        return []
    if len(t) == 1:
        return [("", t[0].replace("-", ""))]
    joined = [x.replace("-", "") for x in t]
    if len(t) == 2:
        if "-" in t[0] and "-" not in t[1]:
            return [(joined[0], joined[1])]
        if "-" in t[1] and "-" not in t[0]:
            return [(joined[1], joined[0])]
        return [(joined[1], joined[0])] if n.surname_first or n.upper[0] and not n.upper[1] else [(joined[0], joined[1])] if n.upper[1] and not n.upper[0] else [(joined[0], joined[1]), (joined[1], joined[0])]
    return [("".join(joined[:-1]), joined[-1]), ("".join(joined[1:]), joined[0])]


# fixed values: initials of romanised Chinese syllables by the finals that may follow them
FINALS = {
    "b p m f": "a o ai ei ao ou an en ang eng i ie iao iu ian in ing u",
    "d t n l": "a e ai ei ao ou an en ang eng ong i ia ie iao iu ian iang in ing u ui un uo uan",
    "g k h": "a e ai ei ao ou an en ang eng ong u ua uo uai ui uan un uang",
    "j q x": "i ia ie iao iu ian in iang ing iong u ue uan un",
    "zh ch sh r z c s": "i a e ai ei ao ou an en ang eng ong u ua uo uai ui uan un uang",
    "y": "a ao e i in ing ong ou u ue uan un an ang",
    "w": "u a o ai ei an en ang eng",
}
SYLLABLES = frozenset(i + f for group, finals in FINALS.items() for i in group.split() for f in finals.split()) | frozenset("a o e ai ei ao ou an en ang eng er".split())


def readings(given: str, known: frozenset[str], han: str) -> list[list[str]]:
    """The ways to read a given name as one or two syllables, failing that as three, or as many as the Han spelling leaves for it."""
    return splits(given, known) or splits(given, known, max(3, len(han) - 1))


def splits(given: str, known: frozenset[str], most: int = 2) -> list[list[str]]:
    """All ways to read a given name as at most `most` known syllables."""
    if not most:
        return []
    out = [[given]] if given in known else []
    for i in range(1, min(6, len(given) - 1) + 1):
        if given[:i] in known:
            out += [[given[:i], *rest] for rest in splits(given[i:], known, most - 1)]
    return out


@dataclass(frozen=True)
class Lexicon:
    """What the table's names tell of tokens; of surnames and common tokens it need only hold those of the names at hand."""

    surnames: frozenset[str]  # of people with a Han spelling
    syllables: frozenset[str]
    common: frozenset[str]  # tokens of several strings


def evidence(name: str) -> list[tuple[str, str, str]]:
    """(role, token, witness) that a string gives for the lexicon."""
    n = parse(name)
    out = [("token", t.replace("-", ""), name) for t in n.tokens if len(t) > 2]
    if n.kind == "person" and len(n.han) >= 2 and len(n.tokens) == 2:
        given, surname = (n.tokens[1], n.tokens[0]) if n.surname_first else (n.tokens[0], n.tokens[1])
        out.append(("surname", surname, n.han))
        fit = (len(n.han) - 1, len(n.han) - 2) if len(n.han) > 3 else (len(n.han) - 1,)  # four characters may begin with a surname of two
        read = [x for x in splits(given.replace("-", ""), SYLLABLES, fit[0]) if len(x) in fit]
        if len(read) == 1:
            out += [("syllable", x, n.han) for x in read[0]]
    return out


def deletions(token: str) -> set[str]:
    """The token and what is left of it without one letter; of two letters the one that is left would tell nothing."""
    return {token} | {token[:i] + token[i + 1 :] for i in range(len(token))} if len(token) > 2 else {token}


Feature = tuple[str, str, str, bool, str]  # type, key, what it adds, whether it is a strong profile's, spelling


def features(name: str, lex: Lexicon) -> tuple[bool, str, str, list[Feature]]:
    """(weak, Han, middle initial, features). Weak: initials, acronym, nickname or a spelling unlike names seen elsewhere; joins others but is joined by none."""
    n = parse(name)
    out: list[Feature] = []
    if n.kind == "group":
        if not n.tokens:
            return True, "", "", [("acronym", n.acronym, "", False, "")] if n.acronym else []
        core = [*n.tokens[:-1], n.tokens[-1][:4]]
        out.append(("full", "group " + " ".join(core), "", True, ""))
        letters = "".join(t[0] for t in n.tokens).upper()
        out += [("acronym", a, "", True, "") for a in {n.acronym or letters}]
        weak = any(t not in lex.common and len(t) > 2 for t in n.tokens[:-1]) or (n.tokens[-1] not in lex.common and len(n.tokens[-1]) > 4)
        whole = "".join(core)
        for i, t in enumerate(core):
            rest = " ".join(core[:i] + ["_"] + core[i + 1 :])
            out += [("typo", f"group {rest} {d}", t, not weak, whole) for d in deletions(t)]
        return weak, "", "", out
    if n.han:
        out.append(("han", n.han, "", True, ""))
    pairs = pairs_of(n)
    if n.initials and len(n.tokens) == 1:
        surname = n.tokens[0].replace("-", "")
        out.append(("initials", f"{surname} {n.initials}", "", False, ""))
        return True, n.han, "", out
    middle = n.initials[:1] if n.initials and len(n.tokens) > 1 else ""
    valid = bool(n.han)
    for given, surname in pairs:
        if not given:
            continue
        if (surname in lex.surnames and readings(given, lex.syllables, n.han)) or (given in lex.common and surname in lex.common):
            valid = True
    nick = False
    unfolded = pairs_of(replace(n, tokens=n.plain))
    for (given, surname), spelt in zip(pairs, unfolded, strict=True):
        if not given:
            out.append(("full", surname, "", True, ""))
            continue
        a, b = sorted((given, surname))
        parts = readings(given, lex.syllables, n.han) if surname in lex.surnames else []
        if n.han and any(len(x) == len(n.han) - 1 for x in parts):
            parts = [x for x in parts if len(x) == len(n.han) - 1]
        loose = len(n.tokens) > 2
        if loose and surname not in lex.surnames and any(s in lex.surnames for _, s in pairs):
            continue  # the other reading is the likelier
        out.append(("full", f"{a} {b}", "", True, ""))
        for formal in NICKNAMES.get(given, "").split():
            nick = True
            c, d = sorted((formal, surname))
            out.append(("nick", f"{c} {d}", "", False, ""))
        out.append(("nick", f"{a} {b}", "", True, ""))
        if parts:
            out += [("initials", surname + " " + "".join(p[0] for p in x), "", True, "") for x in parts]
        elif surname not in lex.surnames or not lex.surnames:
            out.append(("initials", f"{surname} {given[0]}", "", True, ""))
            if middle:
                out.append(("initials", f"{surname} {given[0]}{middle}", "", True, ""))
        for x, y, own in ((given, surname, spelt[0]), (surname, given, spelt[1])):
            out += [("typo", f"{y} {d}", z, valid, f"{z} {y}") for z in dict.fromkeys((x, own)) for d in deletions(z)]
    return (not valid) or nick, n.han, middle, list(dict.fromkeys(out))


SPLIT = r"[;,\n\r]+"


def distinct_names(df: DataFrame, column: str) -> DataFrame:
    """The distinct non-empty items of a column of separated names."""
    items = df.select(F.explode(F.split(F.col(column), SPLIT)).alias("name"))
    return items.select(F.regexp_replace("name", r"(?U)^\s+|\s+$", "").alias("name")).filter("name <> ''").distinct()


def asked(name: str) -> set[str]:
    """The tokens that features() looks up as surname or common token."""
    n = parse(name)
    return set(n.tokens if n.kind == "group" else itertools.chain(*pairs_of(n)))


def lexicon(names: DataFrame, least: int = 3) -> tuple[frozenset[str], DataFrame]:
    """Syllables with two witnesses, which are some of SYLLABLES, and (token, surname, common) of all other tokens with at least `least`."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [e for x in batch.column(0).to_pylist() for e in evidence(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["role", "token", "witness"])

    witnesses = names.mapInArrow(look, "role string, token string, witness string").distinct()
    counts = cut_lineage(witnesses.groupBy("role", "token").count().filter(F.col("count") >= F.when(F.col("role") == "syllable", 2).otherwise(least)))
    syllables = frozenset(r.token for r in counts.filter("role = 'syllable'").collect())  # at most as many as SYLLABLES has
    return syllables, counts.filter("role <> 'syllable'").groupBy("token").agg(F.bool_or(F.col("role") == "surname").alias("surname"), F.bool_or(F.col("role") == "token").alias("common"))


def with_flags(names: DataFrame, flags: DataFrame) -> DataFrame:
    """(name, surnames, common): each name with those of its tokens that are surnames, and that are common."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x, t) for x in batch.column(0).to_pylist() for t in asked(x) or {""}]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["name", "token"])

    tokens = names.select("name").mapInArrow(look, "name string, token string").join(flags, "token", "left")
    return tokens.groupBy("name").agg(F.collect_list(F.when(F.col("surname"), F.col("token"))).alias("surnames"), F.collect_list(F.when(F.col("common"), F.col("token"))).alias("common"))


def near(a, b):
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    distance = F.levenshtein(a, b)
    letters = lambda x: F.array_sort(F.split(x, ""))
    return (distance <= 1) | ((distance == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b)))


def resolve(df: DataFrame, column: str = "authors_display", rounds: int | None = None) -> DataFrame:
    """(name, entity) of each distinct name in the column; names of one author have the same entity, the least of their numbers.

    Null and empty cells have no names; items without letters are entities of their own; repeated strings are one; an empty table gives no
    rows; further columns are ignored. The iteration ends when nothing merges any more; each round leaves fewer entities. If that takes
    more than `rounds`, where given, it is an error."""
    names = cut_lineage(distinct_names(df, column))
    syllables, flags = lexicon(names)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, number, surnames, common in zip(*(batch.column(c).to_pylist() for c in ("name", "id", "surnames", "common")), strict=True):
                weak, han, middle, found = features(name, Lexicon(frozenset(surnames), syllables, frozenset(common)))
                rows.append((number, weak, han, middle, [dict(zip(("type", "key", "token", "strong", "spelling"), f, strict=True)) for f in found]))
            kind = pa.list_(pa.struct([("type", pa.string()), ("key", pa.string()), ("token", pa.string()), ("strong", pa.bool_()), ("spelling", pa.string())]))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.string(), pa.string(), kind), strict=True)], names=["id", "weak", "han", "middle", "features"])

    numbered = names.select("name", F.xxhash64("name").alias("id"))
    described = cut_lineage(with_flags(names, flags).withColumn("id", F.xxhash64("name")).mapInArrow(describe, "id bigint, weak boolean, han string, middle string, features array<struct<type:string,key:string,token:string,strong:boolean,spelling:string>>"))
    flat = described.select("id", F.explode("features").alias("f")).select("id", "f.*")
    keyed = cut_lineage(flat.filter("type <> 'typo'").groupBy("id", "type", "key").agg(F.max("strong").alias("strong")))
    spots = flat.filter("type = 'typo'").select("id", F.xxhash64(context(), "token").alias("spot")).distinct()
    near_by = cut_lineage(near_spots(flat))
    spots = cut_lineage(spots.join(near_by.select("spot").distinct(), "spot", "left_semi"))
    entity = cut_lineage(described.select("id", F.col("id").alias("e"), "weak", own_list("han"), own_list("middle"), F.lit(True).alias("changed")))
    for done in itertools.count():
        links = blocked(keyed, entity, done == 0).unionByName(typed(spots, near_by, entity, done == 0))
        least = cut_lineage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b")).filter("b < a"))
        if least.isEmpty():
            break
        if rounds is not None and done >= rounds:
            raise RuntimeError(f"names still merge after {rounds} rounds")
        hop = least.join(least.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select(F.col("a").alias("e"), F.coalesce("c", "b").alias("n"))  # longer chains are for the next round
        moved = entity.join(hop, "e", "left").select("id", F.coalesce("n", "e").alias("e"), "weak", "han", "middle", F.col("n").isNotNull().alias("moved"))
        # the merged profile: what its members have
        merged = moved.groupBy("e").agg(F.min("weak").alias("weak"), union_of("han"), union_of("middle"), F.max("moved").alias("changed"))
        before, entity = entity, cut_lineage(moved.select("id", "e").join(merged, "e").select("id", "e", "weak", "han", "middle", "changed"))
        release(before, least)
    return numbered.join(entity.select("id", F.col("e").alias("entity")), "id").select("name", "entity")


def own_list(column: str) -> Column:
    return F.filter(F.array(column), lambda x: x != "").alias(column)


def union_of(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column)))).alias(column)


def context() -> Column:
    """What of a typo key is not the token: all before its last word."""
    return F.expr("substring_index(key, ' ', size(split(key, ' ')) - 1)")


def near_spots(flat: DataFrame) -> DataFrame:
    """(spot, other): places of a token in its context of which one is at most one typing error away from the other, in either direction. Each token of a context is
    paired once however many names have it, and never with itself; few tokens share a deletion."""
    tokens = flat.filter("type = 'typo'").select("key", "token").distinct()
    pairs = tokens.withColumnRenamed("token", "x").join(tokens.withColumnRenamed("token", "y"), "key").filter("x < y").filter(near(F.col("x"), F.col("y")))
    both = pairs.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p"), context().alias("c"))
    return both.select(F.xxhash64("c", "p.x").alias("spot"), F.xxhash64("c", "p.y").alias("other")).distinct()


def touched(rows: DataFrame, entity: DataFrame, on: list[str]) -> DataFrame:
    """The rows of blocks that hold an entity which changed in the last round; in all others nothing is left to merge."""
    changed = rows.join(entity.filter("changed").select("id"), "id", "left_semi").select(*on).distinct()
    return rows.join(changed, on, "left_semi")


def blocked(keyed: DataFrame, entity: DataFrame, first_round: bool) -> DataFrame:
    """(a, b): entities to merge since they share a feature, as stars about one of their block. Blocks are aggregated with partial results and their rows meet one
    row of aggregates, so no block is held as a whole.

    The same Han spelling, or the same full name with the same Han spelling and middle initial, always joins. A full name alone joins when those who
    bear it don't differ in Han spelling or middle initial. Initials, nicknames and acronyms join to the one strong profile that has them, and, where none
    has, each other."""
    rows = keyed if first_round else touched(keyed, entity, ["type", "key"])
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit("")))
    exact = F.flatten(F.transform(some("han"), lambda h: F.transform(some("middle"), lambda m: F.struct(F.lit("exact").alias("type"), F.concat_ws("|", "key", h, m).alias("key")))))
    named = (F.col("type") == "full") & ((F.size("han") > 0) | (F.size("middle") > 0))
    keys = F.concat(F.array(F.struct("type", "key")), F.when(named, exact).otherwise(F.array().cast("array<struct<type:string,key:string>>")))
    wide = rows.join(entity, "id").select("e", "strong", F.array_min("han").alias("h0"), F.array_max("han").alias("h1"), F.array_min("middle").alias("m0"), F.array_max("middle").alias("m1"), F.explode(keys).alias("k"))
    own = wide.groupBy("k.type", "k.key", "e").agg(F.max("strong").alias("strong"), *[F.max(x).alias(x) for x in ("h0", "h1", "m0", "m1")])
    strong = F.col("strong")
    block = own.groupBy("type", "key").agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("first"), F.min("h0").eqNullSafe(F.max("h1")).alias("one_han"), F.min("m0").eqNullSafe(F.max("m1")).alias("one_middle"), F.count_if(strong).alias("n_strong"), F.min(F.when(strong, F.col("e"))).alias("only"))
    firm = F.col("type").isin("han", "exact") | ((F.col("type") == "full") & F.col("one_han") & F.col("one_middle"))
    hinted = F.col("type").isin("initials", "nick", "acronym")
    hint = F.when(F.col("n_strong") == 1, F.col("only")).when((F.col("n_strong") == 0) & (F.col("type") != "nick"), F.col("first"))
    stars = block.filter("n > 1").select("type", "key", F.when(firm, F.col("first")).alias("all"), F.when(hinted, hint).alias("weak")).filter("all is not null or weak is not null")
    return own.join(stars, ["type", "key"]).select(F.col("e").alias("a"), F.coalesce("all", F.when(~strong, F.col("weak"))).alias("b")).filter("b is not null and a <> b").distinct()


def typed(spots: DataFrame, near_by: DataFrame, entity: DataFrame, first_round: bool) -> DataFrame:
    """(a, b): weak profiles with the one strong profile that is a typing error away; without a strong one, with the one weak profile. Every spot's profiles are
    aggregated to counts and extremes, from which "the only other one" is exact: where more than two profiles share a spot, there is none."""
    at = spots.join(entity, "id").groupBy("spot", "e").agg(F.max("weak").alias("weak"), F.max("changed").alias("changed"))
    weak, e = F.col("weak"), F.col("e")
    here = at.groupBy("spot").agg(F.min(F.when(~weak, e)).alias("s0"), F.max(F.when(~weak, e)).alias("s1"), F.count_if(weak).alias("n"), F.min(F.when(weak, e)).alias("w0"), F.max(F.when(weak, e)).alias("w1"), F.max("changed").alias("news"))
    met = at.filter("weak").join(near_by, "spot").join(here.withColumnRenamed("spot", "other"), "other")
    inside = (e == F.col("w0")) | (e == F.col("w1"))
    others = F.col("n") - F.when(inside, 1).otherwise(0)
    other = F.when(others == 1, F.when(e == F.col("w0"), F.col("w1")).otherwise(F.col("w0")))
    by = met.select("e", "s0", "s1", others.alias("others"), other.alias("other"), (F.col("news") | F.col("changed")).alias("news")).groupBy("e").agg(F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.max("others").alias("others"), F.min("other").alias("o0"), F.max("other").alias("o1"), F.max("news").alias("news"))
    only = F.when(F.col("s0") == F.col("s1"), F.col("s0")).when(F.col("s0").isNull() & (F.col("others") == 1) & (F.col("o0") == F.col("o1")), F.col("o0"))
    return by.filter("news").select(e.alias("a"), only.alias("b")).filter("b is not null and a <> b")


def variant_pairs(resolved: DataFrame) -> DataFrame:
    """(name_a, name_b), a < b, of names with the same entity. Groups are as large as an author has spellings."""
    a, b = resolved.select("entity", F.col("name").alias("name_a")), resolved.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")
