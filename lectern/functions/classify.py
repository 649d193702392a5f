"""Rule classifiers as Column expressions; each is a chain in which the first match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import _WS, strip

# The terms and patterns below decide results and must stay as they are.
QUANTITY = ["how many", "how much", "how big", "how large", "how long", "how far", "how fast", "how old", "how deep", "how wide", "how tall", "how heavy", "size", "number of", "quantity", "count", "total"]
COMPARISON = ["compare", "comparison", "versus", "vs ", "difference", "better", "worse", "superior", "inferior", "outperform", "exceed", "surpass"]
DEFINITION = ["what is", "what are", "define", "what does"]
BOOLEAN_QUESTION = [r"^is\s+", r"^are\s+", r"^do\s+", r"^does\s+", r"^did\s+", r"^can\s+", r"^could\s+", r"^would\s+", r"^should\s+", r"^(yes|no)\s", r"\?$", r"whether\s+", "is it true that", "does the paper claim", "does the author", "was the model", "were the results"]
EXTRACTIVE_QUESTION = [r"how\s+(many|much|long)", r"what\s+(number|count|size)", r"number\s+of", r"count\s+of", r"total\s+of", "percentage", "percent", "ratio", "score", r"who\s+(proposed|introduced|suggested|developed|created|authored)", r"what\s+(author|researcher|scientist)", r"name\s+of\s+the", r"which\s+(author|researcher)", r"what\s+(is\s+the\s+)?name\s+of", r"what\s+is\s+called", r"which\s+(method|model|algorithm|technique|approach|framework)", r"what\s+(method|model|algorithm)", r"when\s+(was|did|were)", r"what\s+year", r"what\s+date", r"which\s+dataset", r"which\s+corpus", r"what\s+language", r"which\s+(language|framework|dataset)"]
NONE_QUESTION = [r"does\s+not\s+mention", r"doesn't\s+mention", r"does\s+the\s+paper\s+mention", r"is\s+not\s+mentioned", r"is\s+mentioned", r"whether\s+the\s+paper", r"if\s+the\s+paper", "does the paper (say|state|claim|report|discuss)", "is there any (mention|reference|discussion)"]
ABSTRACTIVE_QUESTION = [r"what\s+is\s+(the\s+)?", r"how\s+does", r"how\s+do", r"why\s+does", r"why\s+do", r"why\s+is", r"why\s+are", "explain", "describe", "summarize", "illustrate", r"what\s+are\s+the\s+(main|key|primary)", r"what\s+happens", r"what\s+occurs"]
THRESHOLDS = {"boolean": 0.15, "extractive": 0.05, "none": 0.35, "abstractive": 0.20, "unknown": 0.15}
ROUTE_RULES = [("(.*?)和(.*?)的关系", "graph_local"), ("(.*?)和(.*?)区别", "graph_local"), ("(.*?)引用了(.*?)", "graph_local"), ("(.*?)与(.*?)的", "graph_local"), ("比较(.*?)和(.*?)", "graph_local"), ("(.*?)是谁提出的", "graph_local"), ("谁发明了(.*?)", "graph_local"), ("(.*?)的发展趋势", "graph_global"), ("(.*?)的研究现状", "graph_global"), ("(.*?)领域.*?总结", "graph_global"), ("总结.*?(.*?)领域", "graph_global"), ("(.*?)的演进", "graph_global"), ("(.*?)的未来", "graph_global"), ("什么是(.*?)", "vector"), ("(.*?)的定义", "vector"), ("如何(实现|使用|训练|改进)(.*?)", "vector")]
GLOBAL_WORDS = ["趋势", "总结", "现状", "演进", "发展", "未来", "整体", "领域", "方向"]
LOCAL_WORDS = ["关系", "区别", "对比", "引用", "谁", "哪个", "比较"]
ENTITY_TYPES = ["Model/Architecture", "Method/Technique", "Task", "Dataset", "Metric", "Optimizer/Algorithm", "Framework/Library", "Author/Organization", "Venue", "Hyperparameter", "Experiment Setting", "Result/Conclusion", "Application/Domain", "Other"]
NODE_TYPES = {"Chunk": ["Chunk"], "Paper": ["Paper"], "Reference": ["Reference"], "Model/Architecture": ["Model/Architecture"], "Method/Technique": ["Method/Technique"], "Task": ["Task"], "Metric": ["Metric"], "Dataset": ["Dataset"], "Author/Organization": ["Author/Organization", "Author"], "Venue": ["Venue"], "Optimizer/Algorithm": ["Optimizer/Algorithm"], "Framework/Library": ["Framework/Library"], "ImagePath": ["ImagePath"], "Figure": ["Figure:photo", "Figure:diagram", "Figure:chart", "Figure:table", "Figure:graph", "Figure"]}
NODE_COLORS = [("Figure|Table", "#2ECC71"), ("Author|Organization", "#E74C3C"), ("Paper|Reference", "#3498DB"), ("Concept|Method|Technique", "#9B59B6"), ("Dataset|Metric", "#1ABC9C")]
VISUAL_WORDS = ["图", "figure", "chart", "plot", "graph", "表格", "table", "公式", "formula", "equation", "架构", "architecture", "diagram", "示意图", "图像", "picture", "photo", "image", "多少", "数值", "数据", "哪个大", "哪个小", "颜色", "曲线", "峰值", "趋势"]
VISUAL_QUERY = [r"how\s+(big|large|many|much)", r"what\s+is\s+the\s+size", r"number\s+of", r"count\s+of", r"how\s+long\s+does", r"which\s+is\s+(better|larger|smaller|higher|lower|more|less)", r"compare\s+to", r"compared\s+with", "outperform", r"better\s+than", r"worse\s+than", r"\baccuracy", r"\bprecision", r"\brecall", r"\bf1\s*score", r"\bauc\b", r"\broc\b", r"\bbleu\b", r"\brouge\b", r"\bmeteor\b", r"\bperplexity", r"\bloss\b", r"\berror\s+rate", r"\bperformance\b", r"\bresult\b", r"\bscore\b", r"\bdistribution\b", r"\boverview\b", r"\bsummary\b", r"\bbreakdown\b"]
VISUAL_TEXT = [r"\bfigure\s*\d+", r"\bfig\.\s*\d+", r"\btable\s*\d+", r"\bchart\s*\d+", r"\bplot\s*\d+", r"\balgorithm\s*\d+", r"\bstep\s*\d+", r"\bexperiment\s*\d+", r"\bexample\s*\d+", r"\bdiagram\s*\d+", r"\barchitecture\s*\d+"]
NOT_MAIN = [r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"\b(Reference|References|Bibliography)\b", r"^\[\d+\]", r"\[\s*[A-Z][a-z]+,?\s*\d{4}", r"\(\s*[A-Z][a-z]+\s+et\s+al\.?,?\s*\d{4}", r"\b(Acknowledgment|Appendix|Supplementary)\b"]
NAME_LINE = "^[A-ZÀ-ÿ][a-zà-ÿ´'`-]+(\\s+[A-ZÀ-ÿ][a-zà-ÿ´'`-]+)+$"
#: NAME_LINE and the address of NOT_MAIN for Java, whose matcher calls itself once a turn of a group that may be given back: a line of
#: some thousand names overflowed the stack, which ends an executor. White space parts the words and "@" ends the name of an address, so
#: nothing taken has to be given back; an address begins where no character of one stands before. White space around the names is
#: passed here: stripping each line first took more time than all other rules.
_NAME_LINE = f"^{_WS}*+[A-ZÀ-ÿ][a-zà-ÿ´'`-]++(?:\\s++[A-ZÀ-ÿ][a-zà-ÿ´'`-]++)++{_WS}*+$"
_ADDRESS = r"(?<![a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
LOW_QUALITY = [r"\bwho\s+(is|are)\s+[A-Z]", r"\b(about|by)\s+[A-Z][a-z]+\s+[A-Z][a-z]+", r"\b(first|last)\s+author\b", r"\b(which|what)\s+(university|institute|lab|company)", r"\bwhere\s+(was|is)\s+(this\s+paper|it)\s+published", r"\bwhich\s+(conference|journal|venue)\b", r"\b\d{4}\s+published\b", r"\b(arxiv|doi|citation)\b"]


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def question_type(q: Column) -> Column:
    """quantity, comparison, definition or general."""
    q = F.lower(q)
    return F.when(q.rlike(any_of(QUANTITY)), "quantity").when(q.rlike(any_of(COMPARISON)), "comparison").when(q.rlike(f"^({'|'.join(DEFINITION)})"), "definition").otherwise("general")


def answer_type(q: Column, fixed: bool = False) -> Column:
    """boolean, extractive, none, abstractive or unknown. As first designed, any question that ends in ? is boolean and
    the none patterns are plain substrings, which never match; fixed: neither."""
    q = F.lower(q)
    boolean = [p for p in BOOLEAN_QUESTION if not (fixed and p == r"\?$")]
    none = q.rlike(any_of(NONE_QUESTION)) if fixed else F.lit(False)
    for p in () if fixed else NONE_QUESTION:
        none = none | q.contains(p)
    return F.when(q.rlike(any_of(boolean)), "boolean").when(q.rlike(any_of(EXTRACTIVE_QUESTION)), "extractive").when(none, "none").when(q.rlike(any_of(ABSTRACTIVE_QUESTION)), "abstractive").otherwise("unknown")


def threshold(kind: Column) -> Column:
    out = F.lit(THRESHOLDS["unknown"])
    for k, v in THRESHOLDS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def route(q: Column) -> Column:
    """Retrieval mode: rules, then words, then vector."""
    rules = [q.rlike(p) for p, _ in ROUTE_RULES]
    out = F.when(rules[0], ROUTE_RULES[0][1])
    for hit, (_, mode) in zip(rules[1:], ROUTE_RULES[1:], strict=True):
        out = out.when(hit, mode)
    return out.when(q.rlike("|".join(GLOBAL_WORDS)), "graph_global").when(q.rlike("|".join(LOCAL_WORDS)), "graph_local").otherwise("vector")


def route_entities(q: Column) -> Column:
    """What the groups of the first rule that matches hold; for local words, what stands around 和 or 与."""
    groups = lambda p, n: F.filter(F.array(*[F.regexp_extract(q, p, i + 1) for i in range(n)]), lambda g: g != "")
    none = F.array().cast("array<string>")
    out = None
    for p, _ in ROUTE_RULES:
        out = F.when(q.rlike(p), groups(p, p.count("(")))if out is None else out.when(q.rlike(p), groups(p, p.count("(")))
    around = F.concat(*[F.filter(groups(p, 2), lambda g: F.length(g) > 1) for p in (r"([^和\s]+?)和([^和\s]+)", r"([^与\s]+?)与([^与\s]+)", r"([^?\s]+?)和([^?\s]+?)的区别")])
    return out.when(q.rlike("|".join(GLOBAL_WORDS)), none).when(q.rlike("|".join(LOCAL_WORDS)), F.slice(around, 1, 5)).otherwise(none)


def entity_type(t: Column) -> Column:
    out = F.lit("Other")
    for x in ENTITY_TYPES:
        out = F.when(F.lower(F.trim(t)) == x.lower(), x).otherwise(out)
    return out


def node_type(labels: Column) -> Column:
    out = None
    for kind, names in NODE_TYPES.items():
        hit = F.arrays_overlap(labels, F.array(*map(F.lit, names)))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("Other")


def node_color(kind: Column) -> Column:
    out = None
    for p, color in NODE_COLORS:
        out = F.when(kind.rlike(p), color) if out is None else out.when(kind.rlike(p), color)
    return out.otherwise("#95A5A6")


def grade(mean: Column) -> Column:
    return F.when(mean >= 0.7, "good").when(mean >= 0.5, "fair").otherwise("poor")


def is_reference_title(line: Column) -> Column:
    """A heading of a reference section: the word alone, numbered, in an appendix, or ended by . or : ."""
    clean = F.regexp_replace(F.lower(strip(line)), r"^\d+[\.\)]\s+", "")
    return clean.rlike(r"^(?:references?|bibliography|works cited|literature cited|reference list|参考文献|引用文献)$|^(?:appendix [a-z]\.? references|references s\d+|s\d+ references|supplementary references|appendix references)(?: .*)?$|^(?:references|bibliography)[.:]")


def visual_query(q: Column) -> Column:
    return F.lower(q).rlike("|".join(VISUAL_WORDS)) | F.lower(q).rlike(any_of(VISUAL_QUERY))


def visual_text(t: Column) -> Column:
    return F.coalesce(t, F.lit("")).rlike("(?i)" + any_of(VISUAL_TEXT))


def is_main_content(t: Column) -> Column:
    """No address, reference or citation marks, and fewer than two name lines among the first ten."""
    names = F.filter(F.slice(F.split(t, "\n", 11), 1, 10), lambda x: x.rlike(_NAME_LINE))
    return (F.length(t) > 0) & ~(t.contains("@") & t.rlike("(?i)" + _ADDRESS)) & ~t.rlike("(?i)" + any_of(NOT_MAIN[1:])) & (F.size(names) < 2)


def is_low_quality(q: Column) -> Column:
    return F.lower(q).rlike("(?i)" + any_of(LOW_QUALITY))
