"""From an intent (client id, job id, title) to the bundle of files that a job uses, scored.

All intents are worked at once; an intent is a row of intent_id, cid, job_id, title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.textexpr import base_name, found, found_all
from opslens.operators.graph import distinct_edges, mentions
from opslens.runtime import checkpointed

# Words that are no keywords, and the patterns of titles and control files.
STOPWORDS = ("the", "and", "for", "with", "from", "that", "this", "are", "was", "has", "have", "had", "not", "but", "its", "our", "all", "new", "update", "letter", "monthly", "daily", "weekly", "run", "job")
CID = r"\b([A-Z]{4})\b"
LETTER = r"(?i)(?:Letter\s*|DL)(\d{2,3})\b"
FORMAT_DFA = r"(?i)\w*format_dfa\s*[=:]\s*[\"']?(\w+)[\"']?"
DFA_TOKEN = r"\b([A-Z]{4}[A-Z0-9]{2,})\b"
# Points of a candidate.
POINTS = {"exact_key": 50, "cid_prefix": 15, "scripts": 10, "inserts": 10, "control": 10, "dfa": 5, "phrase": 30, "keyword": 2}


def title_intent(titles: DataFrame) -> DataFrame:
    """Adds cid, letter_number, keywords (in order, repeats kept) and phrase read from ``title``."""
    t = F.coalesce("title", F.lit(""))
    words = F.transform(F.split(t, r"[^A-Za-z0-9]+"), F.lower)
    keywords = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))
    bare = F.regexp_replace(t, r"(?s)^(.*?)\b[A-Z]{4}\b", "$1")
    bare = F.regexp_replace(bare, r"(?is)^(.*?)(?:Letter\s*|DL)\d{2,3}\b", "$1")
    phrase = F.trim(F.regexp_replace(F.regexp_replace(bare, r"^[\s\-–—:,]+", ""), r"[\s\-–—:,]+$", ""))
    return titles.withColumns({"title_cid": F.lower(found(t, CID)), "letter_number": F.lpad(found(t, LETTER), 3, "0"), "keywords": keywords, "phrase": phrase})


def job_family(name: Column) -> Column:
    """A proc name without its variant: closing digits, else its last letter."""
    bare = F.regexp_replace(name, "[0-9]+$", "")
    return F.when(F.length(name) <= 4, name).when((bare != name) & (F.length(bare) >= 5), bare).when(F.length(name) > 5, F.substring(name, F.lit(1), F.length(name) - 1)).otherwise(name)


def build_intents(asked: DataFrame) -> DataFrame:
    """intent_id, cid, job_id, letter_number, keywords, phrase: given values win over those of the title."""
    d = title_intent(asked)
    return d.select("intent_id", F.coalesce(F.lower("cid"), "title_cid").alias("cid"), F.lower("job_id").alias("job_id"), "letter_number", "keywords", "phrase")


# Fixed value: procs of one term that meet the requests for it together.
BLOCK = 256


def find_reach(intents: DataFrame, nodes: DataFrame, procs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which procs are candidates of which intent, never written out as pairs: wanted (intent_id, term, before) and hits (term, proc_name).

    A term is the client or, where no proc is the client's, a keyword; a proc that several terms of an
    intent hit belongs to the first, so ``before`` has the intent's terms before this one.
    """
    names = _proc_names(nodes)
    cuts = names.select("proc_name", F.explode(F.sequence(F.lit(1), F.length("proc_name"))).alias("k")).select("proc_name", F.expr("left(proc_name, k)").alias("cid"))
    by_cid = checkpointed(intents.select("cid").distinct().join(cuts, "cid").distinct())
    clients = by_cid.select("cid").distinct()
    # A keyword is one alphanumeric word, so a proc names it only inside one of its own words.
    words = intents.join(clients, "cid", "left_anti").select("intent_id", F.explode(F.array_distinct("keywords")).alias("kw"))
    named = keyword_hits(words.select("kw").distinct(), procs).join(names, "proc_name", "left_semi")
    hits = checkpointed(by_cid.select(F.concat(F.lit("c:"), "cid").alias("term"), "proc_name").unionByName(named.select(F.concat(F.lit("k:"), "kw").alias("term"), "proc_name")))
    asked = intents.join(clients, "cid", "left_semi").select("intent_id", F.concat(F.lit("c:"), "cid").alias("term")).unionByName(words.select("intent_id", F.concat(F.lit("k:"), "kw").alias("term")))
    often = hits.groupBy("term").agg(F.count("*").alias("n"))
    # The term with most procs comes first: where it hits, nothing has to be compared.
    terms = asked.distinct().join(often, "term").groupBy("intent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "term"))), lambda x: x["term"]).alias("terms"))
    wanted = terms.select("intent_id", "terms", F.posexplode("terms").alias("at", "term")).select("intent_id", "term", F.expr("slice(terms, 1, at)").alias("before"))
    return checkpointed(wanted), hits


def _reach_of(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``find_reach`` of given candidates (intent_id, proc_name): every proc is a term of its own."""
    pairs = candidates.select("intent_id", "proc_name").distinct()
    return pairs.select("intent_id", F.col("proc_name").alias("term"), F.array().cast("array<string>").alias("before")), pairs.select(F.col("proc_name").alias("term"), "proc_name").distinct()


def _proc_names(nodes: DataFrame) -> DataFrame:
    return nodes.filter("type = 'proc'").select(F.substring_index("key", ":", -1).alias("proc_name")).distinct()


def _pairs(wanted: DataFrame, hits: DataFrame, by: list[str]) -> DataFrame:
    """Every pair of wanted (with term, before) and hits (with term, proc_name) once, with all their columns but those.

    Both meet by term, block of procs and the columns ``by``; what is moved are the two sides (wanted once per
    block, so pairs / BLOCK rows), never the pairs. The number of partitions is given, as the sizes of the
    two sides say nothing of the number of their pairs.
    """
    spark = wanted.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    blocks = hits.groupBy("term", *by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    all_terms = hits.select("proc_name", "term").distinct().groupBy("proc_name").agg(F.collect_set("term").alias("proc_terms"))
    h = hits.join(blocks, ["term", *by]).join(all_terms, "proc_name").withColumn("block", F.expr("pmod(hash(proc_name), blocks)")).drop("blocks")
    w = wanted.join(blocks, ["term", *by]).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
    keys = ["term", *by, "block"]
    first = (F.size("before") == 0) | ~F.arrays_overlap("before", "proc_terms")
    return w.repartition(n, *keys).join(h.repartition(n, *keys), keys).filter(first).drop("before", "proc_terms", "term", "block")


def find_candidates(intents: DataFrame, nodes: DataFrame, procs: DataFrame) -> DataFrame:
    """intent_id, proc_key, proc_name, node_id, exact: procs of the client; where there are none, procs whose fields name a keyword.

    ``procs``: proc_name, parsed_json.
    """
    return _candidates(find_reach(intents, nodes, procs), intents, nodes)


def _candidates(reach: tuple[DataFrame, DataFrame], intents: DataFrame, nodes: DataFrame) -> DataFrame:
    wanted, hits = reach
    p = nodes.filter("type = 'proc'").select(F.col("key").alias("proc_key"), F.substring_index("key", ":", -1).alias("proc_name"), F.col("id").alias("node_id"))
    exact = F.coalesce(F.startswith("proc_name", F.col("cid")) & (F.col("proc_name") == F.concat("cid", "job_id")), F.lit(False))
    return _pairs(wanted.join(intents.select("intent_id", "cid", "job_id"), "intent_id"), hits.join(p, "proc_name"), []).select("intent_id", "proc_key", "proc_name", "node_id", exact.alias("exact"))


def keyword_hits(wanted: DataFrame, procs: DataFrame, by: str = "proc_name") -> DataFrame:
    """kw and proc_name (or another column ``by`` of procs) where the fields' text contains the keyword (wanted: kw)."""
    words = procs.select(by, F.explode(F.array_distinct(F.split(F.lower("parsed_json"), r"[^a-z0-9]+"))).alias("w")).filter("length(w) >= 3")
    # Heads of three letters of each distinct word, not of each text: vocabulary grows slowly.
    match = inside_words(wanted.select("kw").distinct(), "kw", words.select("w").distinct(), 3)
    return match.join(words, "w").select("kw", by).distinct()


def inside_words(wanted: DataFrame, col: str, words: DataFrame, head: int) -> DataFrame:
    """(col, w) of the wanted texts that a word (w) contains; both are joined on the first ``head`` letters, then compared whole."""
    heads = f"array_distinct(transform(sequence(1, greatest(length(w) - {head - 1}, 1)), i -> substring(w, i, {head})))"
    cut = words.filter("w != ''").select("w", F.explode(F.expr(heads)).alias("head"))
    return wanted.select(col, F.substring(col, 1, head).alias("head")).join(cut, "head").filter(F.contains("w", F.col(col))).select(col, "w").distinct()


def _inside(wanted: DataFrame, col: str, texts: DataFrame) -> DataFrame:
    """(col, w) of the wanted texts of any length that a text (w) contains; short ones are found by their first letter."""
    return inside_words(wanted.filter(F.length(col) >= 4), col, texts, 4).unionByName(inside_words(wanted.filter(F.length(col).between(1, 3)), col, texts, 1))


def _files(part: DataFrame, step: int, kind: str, source: str, *keys: str) -> DataFrame:
    return part.select(*keys, "proc_name", "path", F.lit(kind).alias("kind"), F.lit(source).alias("source"), F.lit(step).alias("step"))


def _own_files(names: DataFrame, nodes: DataFrame, edges: DataFrame, procs: DataFrame, files: DataFrame) -> DataFrame:
    """proc_name, path, kind, source, step: the files of a proc whoever asks for it."""
    out = _files(names.select("proc_name", F.concat(F.lit("procs/"), F.col("proc_name"), F.lit(".procs")).alias("path")), 1, "procs", "proc_file")

    c = nodes.filter("type = 'proc'").select(F.substring_index("key", ":", -1).alias("proc_name"), F.col("id").alias("node_id")).join(names, "proc_name")
    runs = distinct_edges(edges).filter("rel = 'RUNS'").select(F.col("src").alias("node_id"), F.col("dst").alias("id")).join(nodes.select("id", F.col("canonical_path").alias("path")), "id").filter("path is not null").select("node_id", "path")
    run_files = c.join(runs, "node_id")
    out = out.unionByName(_files(run_files, 2, "script", "RUNS_edge"))

    setup = procs.filter("file_setup is not null").select("proc_name", base_name("file_setup").alias("name"))
    inserts = files.filter("kind = 'insert'").groupBy(base_name("path").alias("name")).agg(F.min("path").alias("path"))
    out = checkpointed(out.unionByName(_files(names.join(setup, "proc_name").join(inserts, "name"), 3, "insert", "procs_file_setup")).distinct())

    scripts = files.filter("kind = 'script'").select("path")
    helper = scripts.filter("path like 'master/%'").select("path", F.regexp_extract("path", r"^master/(.*)$", 1).alias("rest"))
    helper = helper.select("path", F.explode(F.sequence(F.lit(1), F.length("rest"))).alias("k"), "rest").filter("substring(rest, k + 1, 1) = '_'").select("path", F.expr("left(rest, k)").alias("proc_name"))
    late = _files(names.join(helper, "proc_name"), 6, "script", "helper_prefix_match")
    by_name = scripts.groupBy(base_name("path").alias("callee")).agg(F.min("path").alias("path"))
    own = run_files.withColumn("caller", base_name("path")).filter(F.startswith("caller", F.lower(F.substring("proc_name", 1, 4)))).select("proc_name", "caller").distinct()
    late = late.unionByName(_files(own.join(mentions(files.filter("kind = 'script'")), "caller").join(by_name, "callee"), 8, "script", "call_graph_discovery"))
    # the late steps add a path once, and only if none of the early ones has it
    late = late.join(out.select("proc_name", "path").distinct(), ["proc_name", "path"], "left_anti")
    late = late.groupBy("proc_name", "path", "kind").agg(F.min(F.struct("step", "source")).alias("f")).select("proc_name", "path", "kind", "f.source", "f.step")
    return out.unionByName(late)


def _asked_files(reach: tuple[DataFrame, DataFrame], w: DataFrame, sides: DataFrame, names: DataFrame, procs: DataFrame, files: DataFrame) -> DataFrame:
    """intent_id, side, proc_name, path, kind, source, step: control files and definitions, which depend on the client and the letter asked for.

    An intent with a client finds few of its candidates in them, so those pairs are found from the
    paths and codes. Without client the proc's own counts, so its files are those of a side (a letter).
    """
    wanted, hits = reach
    cids = w.filter("side = ''").select("cid").distinct()
    clients = w.filter("side = ''").select("intent_id", "cid", "letter_number")

    def asked(found: DataFrame) -> DataFrame:
        """Only candidates: one of the intent's terms hits the proc."""
        pairs = found.select("intent_id", "proc_name").distinct().join(hits, "proc_name").join(wanted, ["intent_id", "term"], "left_semi").select("intent_id", "proc_name").distinct()
        return found.join(pairs, ["intent_id", "proc_name"], "left_semi").withColumn("side", F.lit(None).cast("string"))

    # Paths are matched first; only the texts of matched files move.
    controls = files.filter("kind = 'control'").select("path", F.lower("path").alias("w"))
    lows = controls.select("w").distinct()
    families = names.select("proc_name", job_family(F.col("proc_name")).alias("family"))
    by_family = checkpointed(_inside(families.select("family").distinct(), "family", lows).join(families, "family").select("proc_name", "w").distinct().join(controls, "w"))
    columns = ["intent_id", "side", "proc_name", "letter_number", "path"]
    matched = asked(clients.join(_inside(cids, "cid", lows), "cid").join(by_family, "w")).select(*columns)
    of_side = by_family.filter(F.contains("w", F.lower(F.substring("proc_name", 1, 4)))).crossJoin(F.broadcast(sides)).withColumn("intent_id", F.lit(None).cast("string"))
    matched = matched.unionByName(of_side.select(*columns))
    lettered = F.coalesce(F.contains("path", F.col("letter_number")), F.lit(False))
    matched = checkpointed(matched.withColumn("lettered", lettered).withColumn("any_lettered", F.max(lettered).over(Window.partitionBy("intent_id", "side", "proc_name"))).filter("lettered or not any_lettered").select(*columns))

    right_letter = F.col("letter_number").isNull() | (F.right("code", F.lit(3)) == F.col("letter_number"))
    formats = files.filter("kind = 'control'").select("path", F.array_distinct(F.transform(found_all(F.coalesce("text_content", F.lit("")), FORMAT_DFA), F.upper)).alias("formats"))
    columns = ["intent_id", "side", "proc_name", "letter_number", "code"]
    from_control = matched.join(formats, "path").withColumn("code", F.explode("formats")).select(*columns).withColumn("from", F.lit(51))
    tokens = checkpointed(procs.join(names, "proc_name", "left_semi").select("proc_name", F.explode(F.array_distinct(found_all("parsed_json", DFA_TOKEN))).alias("code")).distinct())
    begins = tokens.select("code").distinct().select("code", F.explode(F.sequence(F.lit(1), F.length("code"))).alias("k")).select("code", F.expr("left(code, k)").alias("up"))
    of_client = cids.withColumn("up", F.upper("cid")).join(begins, "up").select("cid", "code")
    from_procs = asked(clients.join(of_client, "cid").filter(right_letter).join(tokens, "code")).select(*columns)
    of_side = tokens.filter(F.startswith("code", F.upper(F.substring("proc_name", 1, 4)))).crossJoin(F.broadcast(sides)).withColumn("intent_id", F.lit(None).cast("string"))
    codes = from_control.unionByName(from_procs.unionByName(of_side.select(*columns)).withColumn("from", F.lit(52)))
    codes = checkpointed(codes.filter(right_letter).select("intent_id", "side", "proc_name", "code", "from").distinct())
    # A code is one word; a path contains it inside one of its own words.
    docdefs = files.filter("kind = 'docdef'").select("path", F.upper("path").alias("up"))
    pieces = docdefs.select("path", F.explode(F.array_distinct(F.split("up", r"[^A-Z0-9_]+"))).alias("w")).filter("w != ''")
    cut = _inside(codes.select("code").distinct(), "code", pieces.select("w").distinct()).join(pieces, "w").select("code", "path").distinct()
    resolved = codes.join(cut, "code").groupBy("intent_id", "side", "proc_name", "path").agg(F.min("from").alias("from"))
    source = F.when(F.col("from") == 51, "control_format_dfa").otherwise("procs_dfa_token")
    defined = resolved.select("intent_id", "side", "proc_name", "path", F.lit("docdef").alias("kind"), source.alias("source"), F.lit(5).alias("step"))
    return checkpointed(_files(matched, 4, "control", "control_match", "intent_id", "side").distinct().unionByName(defined))


def _bundle_parts(reach: tuple[DataFrame, DataFrame], intents: DataFrame, nodes: DataFrame, edges: DataFrame, procs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the bundles are put together from, none of it by pair of intent and proc.

    w: the intents that have candidates, with side ('' where there is a client) and jobs, the script paths with
    client and job in them (null: none); own: side, proc_name, path, kind, source, step; asked: as ``own`` by intent_id.
    """
    side = F.when(F.col("cid").isNull(), F.concat(F.lit("letter "), F.coalesce("letter_number", F.lit("")))).otherwise("")
    w = intents.join(reach[0].select("intent_id").distinct(), "intent_id", "left_semi").withColumn("side", side)
    scripts = files.filter("kind = 'script'").select("path", F.lower("path").alias("w"))
    jobs = w.select("intent_id", F.concat("cid", "job_id").alias("cidjob")).filter("cidjob is not null")
    paths = _inside(jobs.select("cidjob").distinct(), "cidjob", scripts.select("w").distinct()).join(scripts, "w").groupBy("cidjob").agg(F.collect_set("path").alias("jobs"))
    w = checkpointed(w.join(jobs.join(paths, "cidjob").select("intent_id", "jobs"), "intent_id", "left"))
    sides = checkpointed(w.filter("side != ''").select("side", "letter_number").distinct())
    names = checkpointed(reach[1].select("proc_name").distinct())
    own = _own_files(names, nodes, edges, procs, files)
    asked = _asked_files(reach, w, sides, names, procs, files)
    every = sides.select("side").unionByName(w.filter("side = ''").select("side").distinct())
    own = own.crossJoin(F.broadcast(every)).select("side", *own.columns).unionByName(asked.filter("side is not null").drop("intent_id"))
    return w, checkpointed(own), asked.filter("side is null").drop("side")


def _put_together(reach: tuple[DataFrame, DataFrame], w: DataFrame, own: DataFrame, asked: DataFrame) -> DataFrame:
    wanted, hits = reach
    columns = ["intent_id", "proc_name", "path", "kind", "source", "step"]
    listed = own.groupBy("side", "proc_name").agg(F.collect_list(F.struct("path", "kind", "source", "step")).alias("files"))
    listed = checkpointed(hits.join(listed, "proc_name"))
    plain = _pairs(wanted.join(w.filter("jobs is null").select("intent_id", "side"), "intent_id"), listed, ["side"])
    out = plain.select("intent_id", "proc_name", F.inline("files")).unionByName(asked.select(*columns))
    if w.filter("jobs is not null").isEmpty():
        return out
    # A path with client and job comes after the early steps and the helpers, before the calls.
    jobs = _pairs(wanted.join(w.filter("jobs is not null").select("intent_id", "side", "jobs"), "intent_id"), listed, ["side"])
    kept = "filter(files, f -> not (f.step = 8 and array_contains(jobs, f.path)))"
    added = "transform(filter(jobs, p -> not exists(files, f -> f.path = p and f.step <= 6)), p -> named_struct('path', p, 'kind', 'script', 'source', 'cidjob_wildcard_match', 'step', 7))"
    jobs = jobs.withColumn("files", F.expr(f"concat({kept}, {added})"))
    return out.unionByName(jobs.select("intent_id", "proc_name", F.inline("files")))


def find_bundles(intents: DataFrame, nodes: DataFrame, edges: DataFrame, procs: DataFrame, files: DataFrame) -> DataFrame:
    """``build_bundles`` of all candidates of the intents; the pairs exist only in the result."""
    reach = find_reach(intents, nodes, procs)
    return _put_together(reach, *_bundle_parts(reach, intents, nodes, edges, procs, files))


def build_bundles(candidates: DataFrame, intents: DataFrame, nodes: DataFrame, edges: DataFrame, procs: DataFrame, files: DataFrame) -> DataFrame:
    """intent_id, proc_name, path, kind, source, step: the files of every candidate.

    ``procs``: proc_name, file_setup, parsed_json; ``files``: path, kind, text_content, one row per path.
    """
    reach = tuple(checkpointed(x) for x in _reach_of(candidates))
    return _put_together(reach, *_bundle_parts(reach, intents, nodes, edges, procs, files))


def score_candidates(candidates: DataFrame, bundles: DataFrame, intents: DataFrame, procs: DataFrame, top: int = 5) -> DataFrame:
    """intent_id, place, proc_name, score: the best candidates of each intent, ties by name."""
    files = _file_points(bundles, "intent_id", "proc_name")
    d = candidates.join(files, ["intent_id", "proc_name"], "left").join(intents.select("intent_id", "cid", "phrase", "keywords"), "intent_id").join(procs.select("proc_name", F.lower("parsed_json").alias("pj")), "proc_name", "left")
    phrase = F.when((F.col("phrase") != "") & F.contains("pj", F.lower("phrase")), POINTS["phrase"]).otherwise(0)
    keyword = F.aggregate(F.coalesce("keywords", F.array().cast("array<string>")), F.lit(0), lambda acc, w: acc + F.when(F.contains(F.coalesce("pj", F.lit("")), w), POINTS["keyword"]).otherwise(0))
    score = F.when(F.col("exact"), POINTS["exact_key"]).otherwise(0) + F.when(F.startswith("proc_name", F.col("cid")), POINTS["cid_prefix"]).otherwise(0) + F.coalesce("points", F.lit(0)) + phrase + keyword
    d = d.withColumn("score", score.cast("int"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("intent_id").orderBy(F.desc("score"), "proc_name")).cast("int")).filter(F.col("place") <= top).select("intent_id", "place", "proc_name", "score")


def _file_points(files: DataFrame, *keys: str) -> DataFrame:
    """points of the kinds of files that there are, by ``keys``."""
    kinds = [F.max(F.when(F.col("kind") == k, POINTS[p]).otherwise(0)) for k, p in (("script", "scripts"), ("insert", "inserts"), ("control", "control"), ("docdef", "dfa"))]
    return files.groupBy(*keys).agg(sum(kinds[1:], kinds[0]).alias("points"))


def _phrase_hits(phrases: DataFrame, fields: DataFrame) -> DataFrame:
    """low, field where the fields' text contains the phrase (phrases: low; fields: field, parsed_json in lower case).

    A text contains the longest word of a phrase inside one of its own words; only such texts are searched.
    """
    longest = F.expr("array_max(transform(split(low, '[^a-z0-9]+'), r -> struct(length(r) as n, r))).r")
    p = phrases.filter("low != ''").distinct().withColumn("anchor", longest)
    words = fields.select("field", F.explode(F.array_distinct(F.split("parsed_json", "[^a-z0-9]+"))).alias("w")).filter("w != ''")
    anchors = _inside(p.filter("anchor != ''").select("anchor").distinct(), "anchor", words.select("w").distinct())
    near = anchors.join(words, "w").select("anchor", "field").distinct().join(p, "anchor").select("low", "field").join(fields, "field")
    bare = p.filter("anchor = ''").select("low").join(fields, F.contains("parsed_json", F.col("low")))
    return near.filter(F.contains("parsed_json", F.col("low"))).select("low", "field").unionByName(bare.select("low", "field"))


def find_scores(intents: DataFrame, nodes: DataFrame, edges: DataFrame, procs: DataFrame, files: DataFrame, top: int = 5) -> DataFrame:
    """``score_candidates`` of all candidates of the intents.

    Procs with the same keywords, phrases and points for their own files score alike for every intent that
    comes by keyword, but for the files of its client. So the first ``top`` by name of each such group stand
    for it; the pairs with files of the client, which are few, are scored one by one and added. Candidates by
    client are scored as pairs.
    """
    reach = wanted, hits = find_reach(intents, nodes, procs)
    w, own, asked = _bundle_parts(reach, intents, nodes, edges, procs, files)
    by_word = wanted.filter("term like 'k:%'").select("intent_id").distinct()
    words = checkpointed(w.filter("jobs is null").join(by_word, "intent_id", "left_semi"))
    rest = checkpointed(w.join(words, "intent_id", "left_anti"))

    direct = wanted.join(rest, "intent_id", "left_semi"), hits
    candidates = checkpointed(_candidates(direct, intents, nodes))
    bundles = _put_together(direct, rest, own, asked.join(rest, "intent_id", "left_semi"))
    scored = checkpointed(score_candidates(candidates, checkpointed(bundles), intents, procs, top))

    # A proc counts once per node and once per file of its fields, as among the candidates.
    hits = hits.filter("term like 'k:%'")
    terms = hits.groupBy("proc_name").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    fields = checkpointed(procs.join(terms, "proc_name", "left_semi").select(F.monotonically_increasing_id().alias("field"), "proc_name", F.lower("parsed_json").alias("parsed_json")))
    kws = keyword_hits(words.select(F.explode("keywords").alias("kw")), fields, "field").groupBy("field").agg(F.array_sort(F.collect_list("kw")).alias("kws"))
    said = _phrase_hits(words.select(F.lower("phrase").alias("low")), fields.select("field", "parsed_json")).groupBy("field").agg(F.array_sort(F.collect_set("low")).alias("phrases"))
    named = nodes.filter("type = 'proc'").select(F.substring_index("key", ":", -1).alias("proc_name"), F.col("id").alias("node_id"))
    texts = fields.select("proc_name", "field").join(kws, "field", "left").join(said, "field", "left")
    units = named.join(terms, "proc_name").join(texts, "proc_name", "left").join(_file_points(own, "side", "proc_name"), "proc_name")
    none = F.array().cast("array<string>")
    units = checkpointed(units.withColumns({"kws": F.coalesce("kws", none), "phrases": F.coalesce("phrases", none)}))

    alike = Window.partitionBy("side", "terms", "kws", "phrases", "points").orderBy("proc_name", "node_id", "field")
    first = checkpointed(units.withColumn("n", F.row_number().over(alike)).filter(F.col("n") <= top).drop("n", "terms"))
    keywords = F.coalesce("keywords", none)
    again = F.filter(keywords, lambda x, i: F.array_position(keywords, x) != i + 1)  # words that the title repeats count again
    wishes = words.select("intent_id", "side", keywords.alias("keywords"), again.alias("again"), F.lower("phrase").alias("low"))
    n_words = F.size(F.array_intersect("kws", "keywords")) + F.when(F.size("again") > 0, F.size(F.filter("again", lambda x: F.array_contains("kws", x)))).otherwise(0)
    phrase = F.when((F.col("low") != "") & F.array_contains("phrases", F.col("low")), POINTS["phrase"]).otherwise(0)
    score = (F.col("points") + phrase + POINTS["keyword"] * n_words).cast("int").alias("score")
    unit = ["intent_id", "proc_name", "node_id", "field"]
    best = Window.partitionBy("intent_id").orderBy(F.desc("score"), "proc_name")

    def place(df: DataFrame) -> DataFrame:
        return df.withColumn("place", F.row_number().over(best).cast("int")).filter(F.col("place") <= top)

    pairs = place(_pairs(wanted.join(wishes, "intent_id"), checkpointed(hits.join(first, "proc_name")), ["side"]).select(*unit, score)).drop("place")
    of_client = _file_points(asked.join(words, "intent_id", "left_semi"), "intent_id", "proc_name").withColumnRenamed("points", "more")
    of_client = of_client.join(wishes, "intent_id").join(units, ["side", "proc_name"]).withColumn("points", F.col("points") + F.col("more")).select(*unit, score)
    every = pairs.unionByName(of_client).groupBy(*unit).agg(F.max("score").alias("score"))
    return scored.unionByName(place(every).select("intent_id", "place", "proc_name", "score"))


#: Files of each kind among the entry points of a bundle.
ENTRY_POINTS = (("script", 3), ("control", 2), ("docdef", 1))


def scope_summary(bundles: DataFrame) -> DataFrame:
    """intent_id, proc_name, the number of files of each kind, and entry_points (paths joined by '|')."""
    kinds = ("procs", "script", "insert", "control", "docdef")
    files = bundles.groupBy("intent_id", "proc_name", "path", "kind").agg(F.min("step").alias("step"))
    counts = files.groupBy("intent_id", "proc_name").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds], F.count("*").alias("n_files"))
    order = F.lit(None).cast("int")
    keep = F.lit(0)
    for i, (kind, n) in enumerate(ENTRY_POINTS):
        order, keep = F.when(F.col("kind") == kind, i).otherwise(order), F.when(F.col("kind") == kind, n).otherwise(keep)
    place = F.row_number().over(Window.partitionBy("intent_id", "proc_name", "kind").orderBy("step", "path"))
    first = files.withColumn("place", place).filter(F.col("place") <= keep)
    points = first.groupBy("intent_id", "proc_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "place", "path"))), lambda x: x["path"]), "|").alias("entry_points"))
    return counts.join(points, ["intent_id", "proc_name"], "left").fillna("", ["entry_points"])


def generate_plan(asked: DataFrame, nodes: DataFrame, edges: DataFrame, procs: DataFrame, files: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores, bundles and scope of each request: what a job is made of, from what is known of it.

    ``asked``: intent_id, cid, job_id, title; ``procs``: proc_name, file_setup, parsed_json;
    ``files``: path, kind, text_content, one row per path. Bundles are those of the ``top`` candidates.
    """
    intents = checkpointed(build_intents(asked))
    scores = checkpointed(find_scores(intents, nodes, edges, procs, files, top))
    kept = checkpointed(build_bundles(scores, intents, nodes, edges, procs, files))
    return scores, kept, scope_summary(kept)
