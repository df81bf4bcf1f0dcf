"""Full-text search: token index, match expressions and BM25.

The expression language has words, "phrases", prefixes (pre*), ^first, column filters (title: x, {title abstract}: x, - title: x),
a + b, NEAR(a b, n), AND, OR, NOT and parentheses; words side by side must all occur. What isn't a valid expression is
searched as one phrase.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.functions.text import tokens, tokens_of

COLUMNS = ("title", "authors", "keywords", "abstract")
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6  # fixed values of the ranking function


GAP = "  "
COLUMN_SPAN = 1 << 32  # more tokens than a column holds


def token_text(x: Column) -> Column:
    """Tokens as one text, each with a blank on either side: " dry  eye ". Words and phrases are counted in it by plain text functions."""
    return F.concat(F.lit(" "), F.array_join(tokens(x), GAP), F.lit(" "))


def token_array(x: Column | str) -> Column:
    return F.filter(F.split(F.btrim(x), GAP), lambda t: t != "")


def token_count(x: str) -> Column:
    """The tokens of a token_text(), which has two blanks for each, and two for none."""
    blanks = F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    return F.when(F.col(x) == GAP, 0).otherwise((blanks / 2).cast("int"))


def token_index(papers: DataFrame) -> DataFrame:
    """(id, title, authors, keywords, abstract, length): the tokens of each column as token_text(), and their number in all; lists are joined by a space."""
    text = {c: F.array_join(c, " ") if c in ("authors", "keywords") else F.col(c) for c in COLUMNS}
    # the generator keeps the optimizer from repeating the tokenization for every use of a column
    made = papers.select("id", F.inline(F.array(F.struct(*[token_text(text[c]).alias(c) for c in COLUMNS]))))
    return made.withColumn("length", reduce(lambda a, b: a + b, [token_count(c) for c in COLUMNS]))


def postings(index: DataFrame) -> DataFrame:
    """(token, id, tf, length, at): how often and where each token occurs in each paper, a place being the column's number times COLUMN_SPAN plus the token's number in it, from 1;
    written in order of tokens, a query finds its own by file statistics."""

    def placed(n: int):
        return lambda t, k: F.struct(t.alias("token"), (k + (n * COLUMN_SPAN + 1)).cast("bigint").alias("at"))

    every = F.concat(*[F.transform(token_array(c), placed(n)) for n, c in enumerate(COLUMNS)])
    flat = index.select("id", "length", F.explode(every).alias("x")).select("id", "length", "x.token", "x.at")
    return flat.groupBy("token", "id", "length").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("at")).alias("at")).select("token", "id", "tf", "length", "at")


def document_frequency(index: DataFrame) -> DataFrame:
    """(token, df, cf): papers with the token and its occurrences. Tokens are counted per paper before the shuffle."""
    return postings(index).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(index: DataFrame) -> DataFrame:
    """(n, avgdl) in one row."""
    return index.agg(F.count(F.lit(1)).alias("n"), (F.sum("length") / F.count(F.lit(1))).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def bm25_part(tf: Column, length: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))


def bm25_of_words(posted: DataFrame, stats: DataFrame, words: list[str], topn: int = 100) -> DataFrame:
    """(id, score): papers with all words, from a table of postings, of which only those of the words are read."""
    words = list(dict.fromkeys(words))
    own = posted.filter(F.col("token").isin(words))
    df = own.groupBy("token").agg(F.count(F.lit(1)).alias("df"))  # one row per word
    scored = own.join(F.broadcast(df), "token").crossJoin(F.broadcast(stats))  # one row
    per = scored.groupBy("id").agg(F.count(F.lit(1)).alias("found"), F.sum(idf(F.col("n"), F.col("df")) * bm25_part(F.col("tf"), F.col("length"), F.col("avgdl"))).alias("score"))
    return per.filter(F.col("found") == len(words)).select("id", "score").orderBy(F.col("score").desc(), "id").limit(topn)


# --- match expressions


@dataclass
class Phrase:
    words: list[str]
    prefix: bool = False
    first: bool = False
    columns: tuple[str, ...] = COLUMNS


@dataclass
class Node:
    kind: str  # phrase, near, and, or, not
    parts: list = field(default_factory=list)
    distance: int = 10

    def phrases(self) -> list[Phrase]:
        return [q for p in self.parts for q in ([p] if isinstance(p, Phrase) else p.phrases())]


class Invalid(ValueError):
    pass


def lex(text: str) -> list[tuple[str, str]]:
    """(kind, text): word, string or the character itself."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c in " \t\r\n":
            i += 1
        elif c == '"':
            got, i = "", i + 1
            while True:
                j = text.find('"', i)
                if j < 0:
                    raise Invalid("open string")
                got += text[i:j]
                i = j + 1
                if text[i : i + 1] != '"':
                    break
                got, i = got + '"', i + 1
            out.append(("string", got))
        elif c in "(){}:,+*^-":
            out.append((c, c))
            i += 1
        elif c.isalnum() or c == "_" or ord(c) > 127:
            j = i
            while j < len(text) and (text[j].isalnum() or text[j] == "_" or ord(text[j]) > 127):
                j += 1
            out.append(("word", text[i:j]))
            i = j
        else:
            raise Invalid(c)
    return out


class Parser:
    """Recursive descent, one method per level: OR, AND, NOT, words side by side, filtered or grouped item."""

    def __init__(self, text: str):
        self.items, self.at = lex(text), 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def take(self, kind: str | None = None) -> tuple[str, str]:
        got = self.peek()
        if got[0] == "end" or (kind and got[0] != kind):
            raise Invalid(f"{kind} expected")
        self.at += 1
        return got

    def is_operator(self, *names: str) -> bool:
        return self.peek()[0] == "word" and self.peek()[1] in names

    def parse(self) -> Node | None:
        node = self.level(("OR", "AND", "NOT"))
        if self.peek()[0] != "end":
            raise Invalid("end expected")
        return node

    def level(self, operators: tuple[str, ...]) -> Node | None:
        below = (lambda: self.level(operators[1:])) if len(operators) > 1 else self.side_by_side
        node = below()
        while self.is_operator(operators[0]):
            self.take()
            right = below()
            if operators[0] == "OR":
                node = Node("or", [x for x in (node, right) if x]) if node or right else None
            elif operators[0] == "AND":
                node = Node("and", [node, right]) if node and right else None
            else:
                node = Node("not", [node, right]) if node and right else node
        return node

    def side_by_side(self) -> Node | None:
        parts, grouped = [], False
        while not parts or (self.peek()[0] not in ("end", ")") and not self.is_operator("AND", "OR", "NOT")):
            grouped |= self.peek()[0] == "("
            parts.append(self.item(COLUMNS))
        if grouped and len(parts) > 1:
            raise Invalid("a group needs an operator beside it")
        parts = [p for p in parts if p]  # what holds no token asks for nothing
        return parts[0] if len(parts) == 1 else Node("and", parts) if parts else None

    def item(self, columns: tuple[str, ...]) -> Node | None:
        negative = self.peek()[0] == "-"
        if negative:
            self.take()
        if self.peek()[0] == "{" or (self.peek()[0] in ("word", "string") and self.peek(1)[0] == ":"):
            named = []
            if self.peek()[0] == "{":
                self.take()
                while self.peek()[0] != "}":
                    named.append(self.take()[1].lower())
                self.take()
            else:
                named.append(self.take()[1].lower())
            self.take(":")
            if any(n not in (*COLUMNS, "paper_id") for n in named):
                raise Invalid("no such column")
            return self.item(tuple(c for c in columns if (c in named) != negative))
        if negative:
            raise Invalid("column expected")
        if self.peek()[0] == "(":
            self.take()
            node = self.level(("OR", "AND", "NOT"))
            self.take(")")
            for p in node.phrases() if node else []:
                p.columns = tuple(c for c in p.columns if c in columns)
            return node
        if self.is_operator("NEAR") and self.peek(1)[0] == "(":
            self.take()
            self.take()
            parts, distance = [], 10
            while self.peek()[0] not in (")", ","):
                parts.append(self.phrase(columns))
            if self.peek()[0] == ",":
                self.take()
                distance = int(self.take("word")[1])
            self.take(")")
            parts = [p for p in parts if p.words]
            return Node("near" if len(parts) > 1 else "phrase", parts, distance) if parts else None
        one = self.phrase(columns)
        return Node("phrase", [one]) if one.words else None

    def phrase(self, columns: tuple[str, ...]) -> Phrase:
        first = self.peek()[0] == "^"
        if first:
            self.take()
        words: list[str] = []
        while True:
            if self.peek()[0] not in ("word", "string") or self.is_operator("AND", "OR", "NOT"):
                raise Invalid("word expected")
            words += tokens_of(self.take()[1])
            if self.peek()[0] != "+":
                break
            self.take()
        prefix = self.peek()[0] == "*"
        if prefix:
            self.take()
        return Phrase(words, prefix, first, columns)


def parse_match(text: str) -> Node | None:
    """The expression of a query; of what isn't valid, the phrase of its words. None where nothing is asked for."""
    try:
        return Parser(text).parse()
    except (Invalid, ValueError):
        words = tokens_of(text)
        return Node("phrase", [Phrase(words)]) if words else None


def places(p: Phrase, column: str) -> Column:
    """The positions, from 1, at which a phrase begins in a column's tokens."""
    n = len(p.words)
    array = token_array(column)
    last = F.size(array) - n + 1

    def here(i: Column) -> Column:
        out = None
        for k, w in enumerate(p.words):
            token = F.try_element_at(array, (i + k).cast("int"))
            one = token.startswith(w) if p.prefix and k == n - 1 else token == w
            out = one if out is None else out & one
        return out

    if p.first:
        return F.when((last >= 1) & here(F.lit(1)), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.when(last >= 1, F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), here)).otherwise(F.array().cast("array<int>"))


def overlaps_itself(words: list[str]) -> bool:
    """Whether two occurrences can share words, as of "a a" in "a a a"."""
    return any(words[:k] == words[-k:] for k in range(1, len(words)))


def occurrences(p: Phrase) -> Column:
    """How often a phrase occurs in its columns."""
    whole = "".join(f" {w} " for w in p.words)
    total = F.lit(0)
    for c in p.columns:
        if p.first:
            total += F.col(c).startswith(whole[:-1] if p.prefix else whole).cast("int")
        elif len(p.words) > 1 and (p.prefix or overlaps_itself(p.words)):
            total += F.when(F.col(c).contains(whole[:-1]), F.size(places(p, c))).otherwise(0)
        elif p.prefix:
            total += F.regexp_count(c, F.lit(f"{whole[:-1]}\\S* "))
        else:
            total += ((F.length(c) - F.length(F.replace(c, F.lit(whole), F.lit("")))) / len(whole)).cast("int")
    return total


def condition(node: Node, number: dict[int, str]) -> Column:
    """Whether a paper matches; number: the column with each phrase's occurrences, in NEAR those that are near."""
    if node.kind in ("phrase", "near"):
        return F.col(number[id(node.parts[0])]) > 0
    parts = [condition(p, number) for p in node.parts]
    if node.kind == "not":
        return parts[0] & ~parts[1]
    return reduce((lambda a, b: a & b) if node.kind == "and" else (lambda a, b: a | b), parts)


def gates(node: Node, number: dict[int, str], gate: Column) -> dict[int, Column]:
    """For each phrase, when its occurrences count: only while all of the expression around it that must hold does. What NOT rules out never counts."""
    if node.kind in ("phrase", "near"):
        own = gate & condition(node, number)
        return {id(p): own for p in node.parts}
    inner = gate if node.kind == "or" else gate & condition(node, number)
    out: dict[int, Column] = {}
    for i, p in enumerate(node.parts):
        out |= gates(p, number, F.lit(False) if node.kind == "not" and i else inner)
    return out


def near_nodes(node: Node) -> list[Node]:
    return [node] if node.kind == "near" else [] if node.kind == "phrase" else [n for p in node.parts for n in near_nodes(p)]


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once per row: the generator keeps the optimizer from repeating them for every use."""
    return df.select("*", F.inline(F.array(F.struct(*[x.alias(n) for n, x in columns.items()])))) if columns else df


def with_near(df: DataFrame, node: Node, begins: dict[int, str]) -> tuple[DataFrame, dict[int, Column]]:
    """For each phrase of a NEAR how many of its begins take part: all phrases begin at or before the last one of them, each with at most `distance` tokens
    between its end and that begin. Begins of different columns are too far apart. begins: the column with each phrase's begins."""

    def within(p: Phrase, reach: int, last: Column):
        return lambda x: (x <= last) & (x >= last - (reach + len(p.words)))

    def all_near(near: Node):
        return lambda last: reduce(lambda a, b: a & b, [F.exists(F.col(begins[id(p)]), within(p, near.distance, last)) for p in near.parts])

    def taking_part(p: Phrase, reach: int, lasts: str):
        return lambda x: F.exists(F.col(lasts), lambda last: within(p, reach, last)(x))

    nodes = near_nodes(node)
    df = once(df, {f"__l{j}": F.filter(F.concat(*[F.col(begins[id(p)]) for p in near.parts]), all_near(near)) for j, near in enumerate(nodes)})
    return df, {id(p): F.size(F.filter(F.col(begins[id(p)]), taking_part(p, near.distance, f"__l{j}"))) for j, near in enumerate(nodes) for p in near.parts}


def scored(counted: DataFrame, stats: DataFrame, node: Node, number: dict[int, str]) -> DataFrame:
    """(id, score) of the matches among (id, length, occurrences of each phrase); stats: one row with n, avgdl and each phrase's papers."""
    matched = counted.filter(condition(node, number)).crossJoin(F.broadcast(stats))  # one row
    open_ = gates(node, number, F.lit(True))
    parts = [F.when(open_[k], idf(F.col("n"), F.col(f"{f}_df")) * bm25_part(F.col(f), F.col("length"), F.col("avgdl"))).otherwise(0.0) for k, f in number.items()]
    return matched.select("id", reduce(lambda a, b: a + b, parts).alias("score"))


def frequencies(number: dict[int, str]) -> list[Column]:
    """The papers with each phrase, near the others of its NEAR or not."""
    return [F.count_if(F.col(f"{f}_all") > 0).alias(f"{f}_df") for f in number.values()]


def both_counts(number: dict[int, str], every: dict[int, Column], near: dict[int, Column]) -> dict[str, Column]:
    return {f: near.get(k, every[k]) for k, f in number.items()} | {f"{f}_all": every[k] for k, f in number.items()}


def shifted_by(n: int):
    return lambda x: x.cast("bigint") + F.lit(n).cast("bigint")


def bm25_raw(index: DataFrame, query: str) -> DataFrame:
    """(id, score) of all papers that match the query, higher being better, by a scan of all token texts."""
    node = parse_match(query)
    if node is None:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    phrases = node.phrases()
    number = {id(p): f"__f{i}" for i, p in enumerate(phrases)}
    close = {id(p): (f"__b{j}_{i}", p) for j, near in enumerate(near_nodes(node)) for i, p in enumerate(near.parts)}
    placed = once(index, {c: F.concat(*[F.transform(places(p, x), shifted_by(COLUMNS.index(x) * COLUMN_SPAN)) for x in p.columns]) for c, p in close.values()})
    placed, taking = with_near(placed, node, {k: c for k, (c, _) in close.items()})
    counted = once(placed, both_counts(number, {id(p): occurrences(p) for p in phrases}, taking))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), (F.sum("length") / F.count(F.lit(1))).alias("avgdl"), *frequencies(number))
    return scored(counted, stats, node, number)


def bm25_posted(posted: DataFrame, stats: DataFrame, query: str) -> DataFrame:
    """bm25_raw() from a table of postings and one row of (n, avgdl): only the postings of the query's tokens are read, which the filter finds by file statistics, and
    phrases, NEAR and columns are told by the places in them. Papers are told apart by id."""
    node = parse_match(query)
    if node is None:
        return posted.select("id", F.lit(0.0).alias("score")).limit(0)
    phrases = node.phrases()
    number = {id(p): f"__f{i}" for i, p in enumerate(phrases)}
    terms = {t: f"__t{i}" for i, t in enumerate(dict.fromkeys((w, p.prefix and k == len(p.words) - 1) for p in phrases for k, w in enumerate(p.words)))}
    whole = [w for w, prefix in terms if not prefix]
    wanted = reduce(lambda a, b: a | b, ([F.col("token").isin(whole)] if whole else []) + [F.col("token").startswith(w) for w, prefix in terms if prefix])
    hit = {t: F.col("token").startswith(t[0]) if t[1] else F.col("token") == t[0] for t in terms}
    per = posted.filter(wanted).groupBy("id").agg(F.max("length").alias("length"), *[F.flatten(F.collect_list(F.when(hit[t], F.col("at")))).alias(c) for t, c in terms.items()])

    def begins(p: Phrase) -> Column:
        out = None
        for k, w in enumerate(p.words):
            own = F.col(terms[w, p.prefix and k == len(p.words) - 1])
            shifted = F.transform(own, shifted_by(-k)) if k else own
            out = shifted if out is None else F.array_intersect(out, shifted)
        if p.first:
            out = F.filter(out, lambda x: x % COLUMN_SPAN == 1)
        if len(p.columns) < len(COLUMNS):
            out = F.filter(out, lambda x: F.floor(x / COLUMN_SPAN).isin([COLUMNS.index(c) for c in p.columns]))
        return out

    found = {id(p): f"__b{i}" for i, p in enumerate(phrases)}
    placed, taking = with_near(once(per, {found[id(p)]: begins(p) for p in phrases}), node, found)
    counted = once(placed, both_counts(number, {k: F.size(c) for k, c in found.items()}, taking))
    return scored(counted, counted.agg(*frequencies(number)).crossJoin(F.broadcast(stats.select("n", "avgdl"))), node, number)


def spread(scored: DataFrame) -> DataFrame:
    """Scores stretched to 0..1 over the rows; 1 for all where they are equal. The extremes come from one row of aggregates, not from a window over all."""
    ends = scored.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    value = F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")))
    return scored.crossJoin(F.broadcast(ends)).select("id", value.alias("score"))


def best_of(matches: DataFrame, topn: int = 100) -> DataFrame:
    """(id, score in 0..1) of the best matches, best first by score and id."""
    return spread(matches.orderBy(F.col("score").desc(), "id").limit(topn))


def full_text(index: DataFrame, query: str, topn: int = 100) -> DataFrame:
    """best_of() the query's matches by a scan."""
    return best_of(bm25_raw(index, query), topn)


def full_text_posted(posted: DataFrame, stats: DataFrame, query: str, topn: int = 100) -> DataFrame:
    """best_of() the query's matches by postings."""
    return best_of(bm25_posted(posted, stats, query), topn)
