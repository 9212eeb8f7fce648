"""Search over files and knowledge: paths, substrings, and an inverted index with phrases.

A query of the index is tokenised like the texts and never fails: words joined by AND, OR
and NOT, "phrases", prefix* terms, ^first words and NEAR(words "and phrases", 10) of at most
so many words between the first and the last.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.textexpr import has_ci

#: Operators that make a query raw (fixed values).
RAW_MARKS = (" AND ", " OR ", " NOT ", "*", "^", "NEAR", '"')
# What the kind filter means.
KINDS = {"scripts": ("script", "master"), "procs": ("procs",), "controls": ("control",), "inserts": ("insert",), "docdef": ("docdef",), "logs": ("logs_inbox",), "refs": ("refs",)}


def of_kind(files: DataFrame, kind: str = "all", scope: DataFrame | None = None) -> DataFrame:
    """Files of a kind (unknown kinds filter nothing), and of a scope (path); no scope or an empty one filters nothing."""
    values = KINDS.get(kind.lower())
    out = files.filter(F.col("kind").isin(*values)) if values else files
    return out.join(scope.select("path").distinct(), "path", "left_semi") if scope is not None and not scope.isEmpty() else out


def search_path(files: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """id, path, kind of files whose path contains a text, in order of paths."""
    d = files.filter(has_ci("path", text)).select("id", "path", "kind")
    return d.orderBy("path", "id").limit(limit) if limit else d


def search_like(files: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """id, path, kind, in_path of files whose path or text contains a text; paths first."""
    in_path, in_text = has_ci("path", text), has_ci(F.coalesce("text_content", F.lit("")), text)
    d = files.filter(in_path | in_text).select("id", "path", "kind", in_path.alias("in_path"))
    return d.orderBy(F.desc("in_path"), "path", "id").limit(limit) if limit else d


_MARKS = "".join(chr(c) for c in range(0x300, 0x370))


def tokens(text: Column) -> Column:
    """Words of a text: runs of letters and digits, lower case, without the accents of Latin letters."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


#: Words of a path stand this far before those of the text, so nothing spans both.
PATH_AT = -(1 << 20)


def build_index(docs: DataFrame, id_col: str, text_col: str, path_col: str | None = None) -> DataFrame:
    """Inverted index: term, doc_id, positions. One row per term and document; words of the path come before those of the text."""
    words = F.transform(tokens(F.coalesce(text_col, F.lit(""))), lambda w, i: F.struct(i.alias("pos"), w.alias("term")))
    if path_col:
        words = F.concat(F.transform(tokens(F.coalesce(path_col, F.lit(""))), lambda w, i: F.struct((i + PATH_AT).alias("pos"), w.alias("term"))), words)
    each = docs.select(F.col(id_col).alias("doc_id"), F.explode(words).alias("w")).select("doc_id", "w.pos", "w.term")
    return each.groupBy("term", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def _plain(text: str) -> list[str]:
    out = text.lower().translate(str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"))
    return [w for w in re.split(r"[^\w]+|_", out) if w]


#: Words between the first and the last of NEAR, where it names no number (fixed value).
NEAR_WORDS = 10


def parse_query(query: str) -> list[list[tuple[bool, str, str]]]:
    """A query as OR of ANDs of (negated, kind, text); kind is term, prefix, phrase, first or near."""
    parts = re.findall(r'NEAR\s*\([^)]*\)?|\^?"[^"]*"?|\S+', query)
    groups: list[list[tuple[bool, str, str]]] = [[]]
    negate = False
    for p in parts:
        if p == "OR":
            groups.append([])
        elif p == "NOT":
            negate = True
        elif re.match(r"NEAR\s*\(", p):
            body = p.split("(", 1)[1].rstrip(")")
            if _near(body)[0]:
                groups[-1].append((negate, "near", body))
            negate = False
        elif p != "AND":
            body = p.strip('"^')
            kind = "first" if p.startswith("^") else "phrase" if p.startswith('"') else "prefix" if p.endswith("*") else "phrase" if len(_plain(p)) > 1 else "term"
            if _plain(body):
                groups[-1].append((negate, kind, body))
            negate = False
    return [g for g in groups if any(not n for n, _, _ in g)]


def _near(body: str) -> tuple[list[list[str]], int]:
    """The words of each phrase of a NEAR group, and its number."""
    n = re.search(r",\s*(\d+)\s*$", body)
    body = body[: n.start()] if n else body
    phrases = [_plain(a or b) for a, b in re.findall(r'"([^"]*)"?|([^\s"]+)', body)]
    return [p for p in phrases if p], int(n.group(1)) if n else NEAR_WORDS


def _words(kind: str, text: str) -> list[str]:
    return [w for p in _near(text)[0] for w in p] if kind == "near" else _plain(text)


def _asks(kind: str, text: str) -> Column:
    """Which index rows a literal needs."""
    words = _words(kind, text)
    if kind == "prefix":
        return F.startswith("term", F.lit(words[0]))
    return F.col("term").isin(*words)


def _places(words: list[str]) -> Column:
    """Where in a document a phrase begins; an aggregate over the document's rows."""
    each = [F.coalesce(F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True), F.array().cast("array<int>")) for w in words]
    if len(words) == 1:
        return each[0]

    def follows(at: Column) -> Column:
        out = F.lit(True)
        for i, p in enumerate(each[1:], 1):
            out = out & F.array_contains(p, at + i)
        return out

    return F.filter(each[0], follows)


def _holds(kind: str, text: str) -> Column:
    """Whether a document's rows fulfil a literal; evaluated in one aggregation per document."""
    words = _words(kind, text)
    if kind == "prefix":
        return F.max(F.startswith("term", F.lit(words[0])))
    if kind == "first":
        return F.exists(_places(words), lambda at: at.isin(0, PATH_AT))
    if kind != "near":
        return F.size(_places(words)) > 0
    phrases, most = _near(text)

    def within(i: int, starts: tuple[Column, ...]) -> Column:
        if i < len(phrases):
            return F.exists(_places(phrases[i]), lambda at: within(i + 1, (*starts, at)))
        if len(starts) == 1:
            return F.lit(True)
        return F.greatest(*starts) - F.least(*[s + len(p) for s, p in zip(starts, phrases, strict=True)]) <= most

    return within(0, ())


def find(index: DataFrame, query: str) -> DataFrame:
    """doc_id of the documents that a query finds: the index is read once, only for the terms that the query names."""
    groups = parse_query(query)
    if not groups:
        return index.limit(0).select("doc_id")
    literals = list(dict.fromkeys((kind, text) for g in groups for _, kind, text in g))
    needed = _asks(*literals[0])
    for lit in literals[1:]:
        needed = needed | _asks(*lit)
    flags = index.filter(needed).groupBy("doc_id").agg(*[_holds(*lit).alias(f"f{i}") for i, lit in enumerate(literals)])
    name = {lit: F.col(f"f{i}") for i, lit in enumerate(literals)}
    hit = F.lit(False)
    for g in groups:
        all_of = F.lit(True)
        for negated, kind, text in g:
            all_of = all_of & (~name[kind, text] if negated else name[kind, text])
        hit = hit | all_of
    return flags.filter(hit).select("doc_id")


def find_term(index: DataFrame, term: str) -> DataFrame:
    return find(index, term)


def find_prefix(index: DataFrame, prefix: str) -> DataFrame:
    return find(index, (_plain(prefix) or [""])[0] + "*")


def find_phrase(index: DataFrame, phrase: str) -> DataFrame:
    return find(index, '"' + phrase.replace('"', " ") + '"')


def smart_search(files: DataFrame, query: str, index: DataFrame | None = None) -> DataFrame:
    """method, id, path: path substring, else exact phrase, else prefix, else substring of texts; raw queries go to the index.

    All tiers are one plan; the best tier that has a row is kept.
    """
    index = build_index(files, "id", "text_content", "path") if index is None else index
    of = lambda docs, m, tier: docs.withColumnRenamed("doc_id", "id").join(files.select("id", "path"), "id").select(F.lit(tier).alias("tier"), F.lit(m).alias("method"), "id", "path")
    if any(m in query for m in RAW_MARKS):
        return of(find(index, query), "fts_raw", 0).drop("tier")
    tiers = [
        search_path(files, query).select(F.lit(0).alias("tier"), F.lit("path_substring").alias("method"), "id", "path"),
        of(find_phrase(index, query), "fts_exact", 1),
        of(find_prefix(index, query), "fts_prefix", 2),
        search_like(files, query).select(F.lit(3).alias("tier"), F.lit("like_full").alias("method"), "id", "path"),
    ]
    rows = tiers[0]
    for t in tiers[1:]:
        rows = rows.unionByName(t)
    best = rows.agg(F.min("tier").alias("tier"))  # one row
    return rows.join(F.broadcast(best), "tier", "left_semi").drop("tier")


#: Characters of a text before and behind a hit, and of a text without one.
AROUND, BEGINNING = 80, 100


def snippet(text: Column | str, query: str) -> Column:
    """What stands around the first hit of a query's words, the hit in >>> and <<<; without one the beginning of the text."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    plain = F.translate(F.lower(t), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    words = "|".join(dict.fromkeys(r"[^\p{L}\p{N}]+".join(_plain(x)) + (r"[\p{L}\p{N}]*" if k == "prefix" else "") if k != "near" else "|".join(_words(k, x)) for g in parse_query(query) for n, k, x in g if not n))
    if not words:
        return F.left(t, F.lit(BEGINNING))
    pattern = rf"(?s)^(.*?(?:^|[^\p{{L}}\p{{N}}]))({words})(?:[^\p{{L}}\p{{N}}].*)?$"
    before, hit = F.length(F.regexp_extract(plain, pattern, 1)), F.length(F.regexp_extract(plain, pattern, 2))
    start = F.greatest(before - AROUND, F.lit(0))
    left = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(t, start + 1, before - start))
    right = F.concat(F.substring(t, before + hit + 1, F.lit(AROUND)), F.when(F.length(t) > before + hit + AROUND, "...").otherwise(""))
    return F.when(hit > 0, F.concat(left, F.lit(">>>"), F.substring(t, before + 1, hit), F.lit("<<<"), right)).otherwise(F.left(t, F.lit(BEGINNING)))


def search_knowledge(codes: DataFrame, cards: DataFrame, text: str) -> DataFrame:
    """kind, ref, o (place), title, preview, section: codes (code hits first) and then case cards (latest first) that contain a text."""
    in_code = has_ci("code", text)
    c = codes.filter(in_code | has_ci("title", text) | has_ci("body", text))
    c = c.select(F.lit("message_code").alias("kind"), F.concat(F.lit("message_codes/"), F.col("entry_id")).alias("ref"), F.struct(F.when(in_code, 0).otherwise(1).alias("a"), F.col("code").alias("b"), F.col("entry_id").alias("c")).alias("o"), F.concat("code", F.lit(" ("), F.coalesce("severity", F.lit("")), F.lit(")")).alias("title"), _preview(("Code", "code"), ("Severity", "severity"), ("Title", "title"), ("", "body"), ("Source", "source_path")))
    k = cards.filter(has_ci("source_path", text) | has_ci("title", text) | has_ci("root_cause", text) | has_ci("fix_summary", text))
    late = F.date_diff(F.lit("9999-01-01").cast("date"), F.col("created_at").cast("date"))
    k = k.select(F.lit("case_card").alias("kind"), F.concat(F.lit("case_cards/"), F.col("id")).alias("ref"), F.struct(late.alias("a"), F.date_format("created_at", "HHmmssSSSSSS").alias("b"), F.col("id").alias("c")).alias("o"), F.coalesce("title", F.concat(F.lit("Case card "), F.col("id"))).alias("title"), _preview(("Source", "source_path"), ("Title", "title"), ("Root cause", "root_cause"), ("Fix", "fix_summary")))
    k = k.withColumn("o", F.struct(F.col("o.a").alias("a"), F.translate("o.b", "0123456789", "9876543210").alias("b"), F.col("o.c").alias("c"))).select(*c.columns)
    out = c.withColumn("section", F.lit(0)).unionByName(k.withColumn("section", F.lit(1)))
    return out


def _preview(*fields: tuple[str, str]) -> Column:
    """What is known of an entry, a labelled line per field that is not null."""
    return F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f"{label}: " if label else ""), F.col(c)) for label, c in fields])), "\n").alias("preview")


def blend(files: DataFrame, codes: DataFrame, cards: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """place, section, ref: knowledge first, at most half; then files; ``limit`` in all (a top-k report)."""
    n_know = max(5, limit // 2)
    n_file = max(5, limit - n_know)
    know = search_knowledge(codes, cards, text).orderBy("section", "o").limit(n_know)
    know = know.withColumn("n", F.row_number().over(Window.orderBy("section", "o"))).select(F.lit("knowledge").alias("section"), "ref", F.col("n").alias("n"))
    hits = search_like(files, text, n_file)
    hits = hits.withColumn("n", F.row_number().over(Window.orderBy(F.desc("in_path"), "path", "id")) + n_know).select(F.lit("file").alias("section"), F.concat_ws("#", "path", "id").alias("ref"), "n")
    return know.unionByName(hits).withColumn("place", F.row_number().over(Window.orderBy("n")).cast("int")).filter(F.col("place") <= limit).drop("n")


def web_search(files: DataFrame, codes: DataFrame, cards: DataFrame, text: str, mode: str = "content", kind: str = "all", scope: DataFrame | None = None, space: str = "all", limit: int = 20, index: DataFrame | None = None) -> DataFrame:
    """place, section, ref of one search over files, knowledge or both (a top-k report).

    Files of a kind and scope are searched by path, or by the index and, where it finds none,
    by substring; with both spaces knowledge comes first and takes half of the places at most.
    """
    f = of_kind(files, kind, scope)
    n_know = limit if space == "knowledge" else max(5, limit // 2)
    n_file = limit if space == "files" else max(5, limit - n_know)
    if mode == "path":
        hits = search_path(f, text).select("id", "path", F.lit(0).alias("tier"), F.lit(0).alias("o"))
    else:
        index = build_index(f, "id", "text_content", "path") if index is None else index
        by_index = find(index, text).withColumnRenamed("doc_id", "id").join(f.select("id", "path"), "id").select("id", "path", F.lit(0).alias("tier"), F.lit(0).alias("o"))
        by_text = search_like(f, text).select("id", "path", F.lit(1).alias("tier"), F.when(F.col("in_path"), 0).otherwise(1).alias("o"))
        both = by_index.unionByName(by_text)
        hits = both.join(F.broadcast(both.agg(F.min("tier").alias("tier"))), "tier", "left_semi")  # one row
    rows = None
    if space != "files":
        know = search_knowledge(codes, cards, text).orderBy("section", "o").limit(n_know)
        rows = know.select(F.lit(0).alias("s"), F.lit("knowledge").alias("section"), "ref", F.row_number().over(Window.orderBy("section", "o")).alias("n"))
    if space != "knowledge":
        top = hits.orderBy("o", "path", "id").limit(n_file)
        part = top.select(F.lit(1).alias("s"), F.lit("file").alias("section"), F.concat_ws("#", "path", "id").alias("ref"), F.row_number().over(Window.orderBy("o", "path", "id")).alias("n"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("place", F.row_number().over(Window.orderBy("s", "n")).cast("int")).filter(F.col("place") <= limit).select("place", "section", "ref")
