"""Texts of plans, matches and diagrams; each gathers a bounded number of rows."""

from __future__ import annotations

import base64
import json
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one text gathers at most; a text that leaves some out says so.
MAX_ROWS = 2_000
LEFT_OUT = "... the rest is left out"
_WORDS = {
    "en": {"bundle": "FILES TO OPEN", "others": "OTHER CANDIDATES", "none": "no matching proc", "score": "score"},
    "ru": {"bundle": "ФАЙЛЫ", "others": "ДРУГИЕ КАНДИДАТЫ", "none": "подходящих процедур нет", "score": "оценка"},
}


def plan_rows(scores: DataFrame, bundles: DataFrame, intent_id: str) -> tuple[list, list]:
    """The scored candidates of an intent and the files of the best, in order of steps and paths."""
    best = scores.filter(F.col("intent_id") == intent_id).orderBy("place").limit(MAX_ROWS).collect()
    if not best:
        return [], []
    files = bundles.filter((F.col("intent_id") == intent_id) & (F.col("proc_name") == best[0]["proc_name"])).orderBy("step", "path").limit(MAX_ROWS + 1).collect()
    return best, files


def plan_text(scores: DataFrame, bundles: DataFrame, intent_id: str, lang: str = "en") -> str:
    w = _WORDS.get(lang, _WORDS["en"])
    best, files = plan_rows(scores, bundles, intent_id)
    if not best:
        return w["none"]
    lines = [f"{best[0]['proc_name']} ({w['score']} {best[0]['score']})", "", w["bundle"]]
    lines += [f"  [{f['kind']}] {f['path']}  ({f['source']})" for f in files[:MAX_ROWS]]
    lines += [f"  {LEFT_OUT}"] if len(files) > MAX_ROWS else []
    if len(best) > 1:
        lines += ["", w["others"], *[f"  {b['place']}. {b['proc_name']} ({b['score']})" for b in best[1:]]]
    return "\n".join(lines)


def plan_json(scores: DataFrame, bundles: DataFrame, intent_id: str) -> str:
    best, files = plan_rows(scores, bundles, intent_id)
    shown = [{"path": f["path"], "kind": f["kind"], "source": f["source"]} for f in files[:MAX_ROWS]]
    return json.dumps({"intent": intent_id, "candidates": [{"proc": b["proc_name"], "score": b["score"]} for b in best], "files": shown, "whole": len(files) <= MAX_ROWS}, ensure_ascii=False)


def match_text(scores: DataFrame, nodes: DataFrame, log_path: str, top: int = 10) -> str:
    """Why a log was matched: the best nodes with the points (tenths) of each strategy."""
    one = scores.filter(F.col("log_path") == log_path)
    each = F.array_sort(F.collect_list(F.struct("strategy", "token", "points"))).alias("why")
    rows = one.groupBy("node_id").agg(F.sum("points").alias("points"), each).join(nodes.select(F.col("id").alias("node_id"), "key"), "node_id").orderBy(F.desc("points"), "node_id").limit(top).collect()
    out = []
    for i, r in enumerate(rows, 1):
        out.append(f"{i}. {r['key']} {r['points'] / 10:.1f}")
        out += [f"   +{x['points'] / 10:.1f} {x['strategy']}:{x['token']}" for x in r["why"]]
    return "\n".join(out)


def _node(name: str) -> str:
    return "n_" + "".join(c if c.isalnum() else "_" for c in name)


def diagram(edges: DataFrame, proc_name: str, scripts_only: bool = False) -> str:
    """The diagram of a proc as text of the Mermaid language (edges of ``graph.diagram_edges``)."""
    d = edges.filter(F.col("proc_name") == proc_name)
    if scripts_only:
        d = d.filter("label in ('RUNS', 'calls', 'helper')")
    rows = d.orderBy("src", "dst", "label").limit(MAX_ROWS + 1).collect()
    more, rows = len(rows) > MAX_ROWS, rows[:MAX_ROWS]
    names = sorted({r["src"] for r in rows} | {r["dst"] for r in rows})
    return "\n".join(["graph TD", *[f'    {_node(n)}["{n}"]' for n in names], *[f"    {_node(r['src'])} -->|{r['label']}| {_node(r['dst'])}" for r in rows], *([f"    %% {LEFT_OUT}"] if more else [])])


def diagram_link(code: str) -> str:
    """Link that opens a diagram in the public Mermaid editor: its state as JSON, deflated, in URL-safe base64."""
    state = {"code": code, "mermaid": '{"theme": "default"}', "autoSync": True, "updateDiagram": True}
    packed = zlib.compress(json.dumps(state, separators=(",", ":")).encode(), 9)
    return "https://mermaid.live/edit#pako:" + base64.urlsafe_b64encode(packed).decode().rstrip("=")


def prompt(pack: str, lang: str = "en") -> str:
    """A context pack with the question that goes with it."""
    ask = {"en": "Using only the facts below, name the most likely cause, how to confirm it and what to check next.", "ru": "По фактам ниже назовите вероятную причину, как её подтвердить и что проверить дальше."}
    return f"{ask.get(lang, ask['en'])}\n\n{pack}"


def size_estimate(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and estimated tokens (four characters each) of texts."""
    return texts.select(id_col, F.floor(F.length(F.coalesce(text_col, F.lit(""))) / 4).cast("long").alias("tokens"))


def diff_prompt(header: DataFrame, diffs: DataFrame, states: DataFrame) -> str:
    """A change as text: description, files, the diffs taken, and what was left out and why.

    ``header`` is of ``diffs.report_header``, ``states`` of ``diffs.capped_diffs`` for ``diffs``.
    """
    h = header.limit(1).collect()
    out = [f"Description: {h[0]['description']}", f"Parallel ID: {h[0]['parallel_id']}", "Files:", *[f"  - {f}" for f in h[0]["files"]], ""] if h else []
    taken = diffs.join(states.select("change_id", "ord", "state", "size"), ["change_id", "ord"]).orderBy("change_id", "ord").select("file", "state", F.expr("left(diff, size)").alias("diff")).limit(MAX_ROWS + 1).collect()
    more, taken = len(taken) > MAX_ROWS, taken[:MAX_ROWS]
    for r in taken:
        if r["state"] in ("taken", "truncated"):
            out += [f"--- {r['file']}{' (cut)' if r['state'] == 'truncated' else ''}", r["diff"], ""]
    left = [f"  - {r['file']}: {r['state']}" for r in taken if r["state"] not in ("taken", "truncated")]
    return "\n".join([*out, *(["Left out:", *left] if left else []), *([LEFT_OUT] if more else [])])
