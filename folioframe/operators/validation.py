"""Validation of manifests and values, as rules that give rows of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quality import issues


def portable_path(path: Column) -> Column:
    """A relative path with forward slashes, no drive, scheme, NUL or empty, . or .. segment."""
    bad = F.coalesce(path, F.lit("")).rlike(r"^$|\\|\x00|^/|^[A-Za-z]:|://|(^|/)(\.|\.\.)?(/|$)")
    return path.isNotNull() & ~bad


def sha256_text(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def xml_date_time(value: Column) -> Column:
    """Whether a text is an xsd:dateTime: a year of four digits or more but not zero, days by month and leap year, 24:00:00
    allowed, a zone of fourteen hours at most or none."""
    pattern = r"^-?([0-9]{4,})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})(\.[0-9]+)?(Z|[+-]([0-9]{2}):([0-9]{2}))?$"
    n = lambda i: F.regexp_extract(value, pattern, i).try_cast("int")
    year, month, day, hour, minute, second = map(n, range(1, 7))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    long_year = F.regexp_extract(value, pattern, 1).rlike("^0[0-9]{4,}$")
    end = (hour == 24) & (minute == 0) & (second == 0) & F.regexp_extract(value, pattern, 7).rlike(r"^(\.0+)?$")
    zone = (F.regexp_extract(value, pattern, 9) == "") | ((n(9) < 14) & (n(10) < 60)) | ((n(9) == 14) & (n(10) == 0))
    good = value.rlike(pattern) & (year > 0) & ~long_year & month.between(1, 12) & day.between(1, days) & ((hour < 24) & (minute < 60) & (second < 60) | end) & zone
    return F.coalesce(good, F.lit(False))


#: Metrics that a comparison has limits for.
METRICS = ("mean_absolute_diff", "root_mean_square_diff", "mismatch_ratio", "layout_structure_diff")


def threshold_issues(thresholds: DataFrame, key: str) -> DataFrame:
    """Limits that are missing or outside 0..1."""
    rules = {}
    for m in METRICS:
        rules[f"{m}-missing"] = F.col(m).isNull()
        rules[f"{m}-range"] = ~F.col(m).between(0.0, 1.0)
    return issues(thresholds, key, rules)


def page_issues(pages: DataFrame) -> DataFrame:
    """pages: case_id, reference_id, page_number, width_points, height_points, image_path, image_sha256. Issues of single rows, and
    pages that stand twice or are not numbered from 1 without gaps."""
    keyed = pages.withColumn("key", F.concat_ws("/", "case_id", "reference_id", F.col("page_number").cast("string")))
    single = issues(
        keyed, "key",
        {
            "page-number": F.col("page_number").isNull() | (F.col("page_number") < 1), "width": ~(F.col("width_points") > 0) | F.col("width_points").isNull(), "height": ~(F.col("height_points") > 0) | F.col("height_points").isNull(),
            "path": ~portable_path(F.col("image_path")), "sha256": ~sha256_text(F.col("image_sha256")),
        },
    )
    counted = keyed.groupBy("case_id", "reference_id", "page_number").agg(F.count("*").alias("n"))
    w = Window.partitionBy("case_id", "reference_id").orderBy("page_number")
    ranked = counted.withColumn("rank", F.row_number().over(w)).withColumn("key", F.concat_ws("/", "case_id", "reference_id", F.col("page_number").cast("string")))
    return single.unionByName(issues(ranked, "key", {"duplicate-page": F.col("n") > 1, "page-gap": F.col("rank") != F.col("page_number")}))


def environment_differences(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field, expected, actual of each field that isn't the same on both sides (null equal to null)."""
    pair = lambda df, n: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("s")).select(*keys, "s.field", F.col("s.value").alias(n))
    both = pair(expected, "expected").join(pair(actual, "actual"), [*keys, "field"], "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual")))


def artifact_issues(expected: DataFrame, files: DataFrame) -> DataFrame:
    """expected: path, sha256; files: path, content (of binaryFile). Files that are missing or differ: path, issue."""
    found = files.select("path", F.sha2("content", 256).alias("actual"))
    issue = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("sha256"), "digest")
    return expected.join(found, "path", "left").withColumn("issue", issue).where("issue IS NOT NULL").select("path", "issue")


def page_sizes(info: Column) -> Column:
    """array<struct<page, width, height, rotation-free points>> from the text that lists a document's page sizes."""
    lines = F.regexp_extract_all(info, F.lit(r"(?m)^Page\s+[0-9]+\s+size:\s+[0-9.]+ x [0-9.]+ pts"), F.lit(0))
    pattern = r"Page\s+([0-9]+)\s+size:\s+([0-9.]+) x ([0-9.]+) pts"
    part = lambda line, i, t: F.regexp_extract(line, pattern, i).cast(t)
    return F.transform(lines, lambda x: F.struct(part(x, 1, "int").alias("page"), part(x, 2, "double").alias("width"), part(x, 3, "double").alias("height")))


def ready(samples: DataFrame, by: list[str], order: str, signature: str, needed: int = 2) -> DataFrame:
    """samples (issues: number of problems) with ``ready``: needed samples in a row with the same signature and no problem."""
    w = Window.partitionBy(*by).orderBy(order)
    fresh = F.coalesce((F.col("issues") > 0) | ~F.col(signature).eqNullSafe(F.lag(signature).over(w)) | (F.lag("issues").over(w) > 0), F.lit(True))
    islands = samples.withColumn("__new", fresh.cast("int")).withColumn("__g", F.sum("__new").over(w))
    run = F.row_number().over(Window.partitionBy(*by, "__g").orderBy(order))
    return islands.withColumn("ready", (run >= needed) & (F.col("issues") == 0)).drop("__new", "__g")


def manifest_issues(cases: DataFrame) -> DataFrame:
    """cases: schema_version, case_id, path, sha256, width_points, height_points. Issues of rows and case ids that stand twice."""
    rules = {
        "schema-version": ~F.coalesce(F.col("schema_version") == 1, F.lit(False)), "case-id": ~F.coalesce(F.col("case_id").rlike("^[a-z0-9][a-z0-9._-]*$"), F.lit(False)), "path": ~portable_path(F.col("path")), "sha256": ~sha256_text(F.col("sha256")),
        "geometry": ~F.coalesce((F.col("width_points") > 0) & (F.col("height_points") > 0), F.lit(False)),
    }
    twice = cases.groupBy("case_id").agg(F.count("*").alias("n"))
    return issues(cases, "case_id", rules).unionByName(issues(twice, "case_id", {"duplicate-case": F.col("n") > 1}))


#: Actions that an edit scenario may take, with their fields (fixed values).
ACTIONS = {
    "select-paragraph": ("nodeIndex",),
    "select-table-cell": ("tableIndex", "rowIndex", "cellIndex"),
    "set-text-range": ("range",),
    "commit-paragraph-text": ("nodeIndex", "text"),
    "commit-table-cell-text": ("tableIndex", "rowIndex", "cellIndex", "text"),
    "toggle-bold": (),
    "toggle-italic": (),
    "toggle-underline": (),
    "toggle-strike": (),
    "set-text-color": ("color",),
    "set-highlight": ("color",),
    "set-font-family": ("fontFamily",),
    "set-font-size": ("fontSizePt",),
    "set-alignment": ("alignment",),
    "toggle-list": ("listType",),
    "set-line-spacing": ("lineMultiple",),
    "insert-table-row": ("tableIndex", "rowIndex", "direction"),
    "insert-table-column": ("tableIndex", "cellIndex", "direction", "rowIndex"),
    "delete-table-row": ("tableIndex", "rowIndex"),
    "delete-table-column": ("tableIndex", "cellIndex", "rowIndex"),
    "undo": (),
    "redo": (),
    "accept-tracked-change": ("index",),
    "reject-tracked-change": ("index",),
    "create-comment": ("text", "options"),
    "set-comment-resolved": ("commentId", "resolved"),
}
#: Bounds of indexes, of text offsets and texts, of a scenario's actions, and of numbers (fixed values).
MAX_INDEX, MAX_OFFSET, MAX_TEXT, MAX_ACTIONS = 1_000_000, 10_000_000, 1_000_000, 10_000
NUMBERS = {"fontSizePt": (1.0, 400.0), "lineMultiple": (0.1, 10.0)}
#: Values of fields that have a few only; null is one of alignment's (fixed values).
CHOICES = {"alignment": ("null", '"left"', '"center"', '"right"', '"justify"'), "listType": ('"unordered"', '"ordered"')}
DIRECTIONS = {"insert-table-row": ("above", "below"), "insert-table-column": ("left", "right")}
INDEXES = ("nodeIndex", "tableIndex", "rowIndex", "cellIndex", "index", "commentId")
LOCATIONS = {"paragraph": ("nodeIndex",), "table-cell": ("tableIndex", "rowIndex", "cellIndex", "paragraphIndex")}


def bad_index(value: Column, most: int = MAX_INDEX) -> Column:
    return ~F.coalesce(value.rlike("^[0-9]{1,18}$") & (value.try_cast("bigint") <= most), F.lit(False))


def location_issue(json: Column) -> Column:
    """Whether a place (a paragraph, or a paragraph of a table's cell, with an offset) is wrong."""
    boundary = F.from_json(json, "map<string,string>")
    place = F.from_json(F.try_element_at(boundary, F.lit("location")), "map<string,string>")
    bad = ~F.coalesce(F.forall(F.map_keys(boundary), lambda k: k.isin("location", "offset")), F.lit(False)) | bad_index(F.try_element_at(boundary, F.lit("offset")), MAX_OFFSET)
    kind, each = F.try_element_at(place, F.lit("kind")), F.lit(True)
    only = lambda keys, names: F.forall(keys, lambda k: k.isin("kind", *names))
    for name, fields in LOCATIONS.items():
        wrong = ~only(F.map_keys(place), fields)
        for f in fields:
            wrong = wrong | bad_index(F.try_element_at(place, F.lit(f)))
        each = F.when(kind == name, wrong).otherwise(each)
    return bad | F.coalesce(each, F.lit(True))


def range_issue(json: Column) -> Column:
    """Whether a text range is wrong: null is right (no range); ends of one kind, the end not before the start."""
    ends = F.from_json(json, "map<string,string>")
    start, end = (F.try_element_at(ends, F.lit(k)) for k in ("start", "end"))
    number = lambda e, path: F.get_json_object(e, f"$.{path}").try_cast("bigint")

    def place(e: Column) -> Column:
        """The order of places: block, row, cell, paragraph in the cell, offset."""
        inner = [F.coalesce(number(e, f"location.{f}"), F.lit(-1)) for f in ("rowIndex", "cellIndex", "paragraphIndex")]
        return F.array(F.coalesce(number(e, "location.nodeIndex"), number(e, "location.tableIndex")), *inner, number(e, "offset"))

    wrong = ~F.forall(F.map_keys(ends), lambda k: k.isin("start", "end")) | location_issue(start) | location_issue(end) | (place(start) > place(end))
    return F.when(F.trim(json) == "null", False).otherwise(F.coalesce(wrong, F.lit(True)))


def edit_action_issues(actions: DataFrame, limit: int = MAX_ACTIONS) -> DataFrame:
    """actions: scenario_id, seq, action (a JSON object with its type and fields; expect may stand in any). key, rule of actions
    with an unknown type, fields that aren't theirs, and missing or wrong values; of numbers with gaps, and of scenarios that are too long."""
    fields = F.from_json("action", "map<string,string>")
    value = lambda name: F.try_element_at(F.col("__f"), F.lit(name))
    keyed = actions.withColumn("__f", fields).withColumn("__t", F.get_json_object("action", "$.type")).withColumn("key", F.concat_ws("/", "scenario_id", F.col("seq").cast("string")))
    kind = F.col("__t")
    known = F.coalesce(kind.isin(*ACTIONS), F.lit(False))
    own = F.create_map(*[x for t, f in ACTIONS.items() for x in (F.lit(t), F.array(*map(F.lit, ("type", "expect", *f))))])
    has = lambda name: kind.isin(*[t for t, f in ACTIONS.items() if name in f])
    rules = {"type": ~known, "fields": known & ~F.coalesce(F.forall(F.map_keys("__f"), lambda k: F.array_contains(F.try_element_at(own, kind), k)), F.lit(False))}
    for name in INDEXES:
        optional = kind.isin("insert-table-column", "delete-table-column") & value(name).isNull() if name == "rowIndex" else F.lit(False)
        rules[name] = has(name) & ~optional & bad_index(value(name))
    quoted = lambda name: F.coalesce(F.get_json_object("action", f"$.{name}"), F.lit(None).cast("string"))
    text = quoted("text")
    rules["text"] = has("text") & (text.isNull() | (F.length(text) > MAX_TEXT) | ((kind == "create-comment") & (F.trim(text) == "")))
    rules["color"] = has("color") & ~F.coalesce((F.array_contains(F.map_keys("__f"), F.lit("color")) & value("color").isNull()) | quoted("color").rlike("^#[a-f0-9]{6}$"), F.lit(False))
    font = quoted("fontFamily")
    rules["fontFamily"] = has("fontFamily") & ~F.coalesce(F.length(font).between(1, 128) & (F.btrim(font) == font) & ~font.rlike(r"[\x00-\x1f\x7f]"), F.lit(False))
    for name, (low, high) in NUMBERS.items():
        rules[name] = has(name) & ~F.coalesce(value(name).try_cast("double").between(low, high), F.lit(False))
    for name, some in CHOICES.items():
        plain = F.when(quoted(name).isNull() & F.array_contains(F.map_keys("__f"), F.lit(name)), "null").otherwise(F.concat(F.lit('"'), quoted(name), F.lit('"')))
        rules[name] = has(name) & ~F.coalesce(plain.isin(*some), F.lit(False))
    for t, some in DIRECTIONS.items():
        rules[f"direction-{some[0]}"] = (kind == t) & ~F.coalesce(quoted("direction").isin(*some), F.lit(False))
    rules["resolved"] = has("resolved") & ~F.coalesce(value("resolved").isin("true", "false"), F.lit(False))
    options = F.from_json(value("options"), "map<string,string>")
    rules["options"] = has("options") & ~F.coalesce((F.array_sort(F.map_keys(options)) == F.array(*map(F.lit, ("author", "date", "initials")))) & F.forall(F.map_values(options), lambda v: F.length(v) > 0), F.lit(False))
    rules["range"] = has("range") & (~F.array_contains(F.map_keys("__f"), F.lit("range")) | (value("range").isNotNull() & range_issue(value("range"))))
    placed = keyed.withColumn("n", F.row_number().over(Window.partitionBy("scenario_id").orderBy("seq")))
    sizes = actions.groupBy("scenario_id").agg(F.count("*").alias("n"))
    return issues(keyed, "key", rules).unionByName(issues(placed, "key", {"order": F.col("n") - 1 != F.col("seq")})).unionByName(issues(sizes, "scenario_id", {"length": F.col("n") > limit}))


#: What an edit summary is compared by, and the expectations of a model's digest (fixed values).
SUMMARY = (
    "semanticModelVersion", "semanticModelDigest", "bodyNodeCount", "bodyParagraphNodeCount", "bodyTableNodeCount", "paragraphCount", "tableCount", "imageCount", "formFieldCount", "trackedChangeCount", "commentCount", "resolvedCommentCount", "sectionCount",
    "headerSectionCount", "footerSectionCount", "hasTitlePageSection", "firstParagraph", "firstTableCell",
)
EXPECTED_CHANGE = {"changed": True, "changed-from-source": True, "unchanged": False, "same-as-source": False}


def comparable_summary(summary: Column) -> Column:
    """Of an edit summary (JSON text) the fields that are compared, as a map of JSON texts."""
    return F.map_filter(F.from_json(summary, "map<string,string>"), lambda k, _: k.isin(*SUMMARY))


def semantic_digest(value: Column) -> Column:
    """32 hexadecimal digits of a value's JSON: equal values have equal ones."""
    return F.md5(F.to_json(value))


def expectation_issue(expectation: Column, before: Column, after: Column) -> Column:
    """What is wrong between two model digests; null where it is as expected."""
    good = before.rlike("^[a-f0-9]{32}$") & after.rlike("^[a-f0-9]{32}$")
    wants = F.try_element_at(F.create_map(*[F.lit(x) for kv in EXPECTED_CHANGE.items() for x in kv]), expectation)
    return F.when(~F.coalesce(good, F.lit(False)), "digest").when(wants.isNull(), "expectation").when(wants & (before == after), "unchanged").when(~wants & (before != after), "changed")


def edit_results(scenarios: DataFrame) -> tuple[DataFrame, DataFrame]:
    """scenarios: scenario_id, path, sha256 of the document that an edit run wrote. (each with case_id and source struct<path, sha256>
    under which it is compared, issues: paths that aren't portable, digests that are none)."""
    registered = scenarios.withColumn("case_id", F.col("scenario_id")).withColumn("source", F.struct("path", "sha256"))
    return registered, issues(scenarios, "scenario_id", {"path": ~F.coalesce(portable_path(F.col("path")), F.lit(False)), "sha256": ~F.coalesce(sha256_text(F.col("sha256")), F.lit(False))})


def same_corpus(reference: DataFrame, viewer: DataFrame) -> DataFrame:
    """case_id, same: whether both manifests name the same corpus and source digest for a case (null equal to null)."""
    v = viewer.select("case_id", F.col("corpus_id").alias("__c"), F.col("source_sha256").alias("__s"), F.lit(True).alias("__v"))
    both = reference.withColumn("__r", F.lit(True)).join(v, "case_id", "full")
    return both.select("case_id", (F.col("__r").isNotNull() & F.col("__v").isNotNull() & F.col("corpus_id").eqNullSafe(F.col("__c")) & F.col("source_sha256").eqNullSafe(F.col("__s"))).alias("same"))


def bound_scenarios(scenarios: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scenarios joined to their source case, issues: unknown sources and ids that are also case ids)."""
    joined = scenarios.join(sources.select("case_id", F.col("sha256").alias("source_sha256")), "case_id")
    unknown = scenarios.join(sources, "case_id", "left_anti").select(F.col("scenario_id").alias("key"), F.lit("unknown-source").alias("rule"))
    clash = scenarios.join(sources.select(F.col("case_id").alias("scenario_id")), "scenario_id", "left_semi").select(F.col("scenario_id").alias("key"), F.lit("id-collision").alias("rule"))
    return joined, unknown.unionByName(clash)


def capture_targets(references: DataFrame, cases: list[str] | None = None, reference_ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """references: case_id, reference_id, source. (a row for each case with its source and reference ids in order, issues: references
    that stand twice, selectors that nothing matches). Without selectors all references count."""
    wanted = F.lit(True)
    for name, some in (("case_id", cases), ("reference_id", reference_ids)):
        wanted = wanted & F.col(name).isin(*some) if some else wanted
    chosen = references.where(wanted)
    groups = chosen.groupBy("case_id").agg(F.min_by("source", "reference_id").alias("source"), F.array_sort(F.collect_list("reference_id")).alias("reference_ids"))
    twice = chosen.groupBy("case_id", "reference_id").agg(F.count("*").alias("n")).withColumn("key", F.concat_ws("/", "case_id", "reference_id"))
    bad = issues(twice, "key", {"duplicate": F.col("n") > 1})
    for name, some in (("case_id", cases), ("reference_id", reference_ids)):
        if some:
            asked = references.sparkSession.createDataFrame([(x,) for x in some], "key string")
            bad = bad.unionByName(asked.join(chosen.select(F.col(name).alias("key")), "key", "left_anti").select("key", F.lit("unknown").alias("rule")))
    return groups, bad


def page_path(case_id: Column, reference_id: Column, page_number: Column) -> Column:
    """The portable path of a page's picture."""
    return F.concat_ws("/", case_id, reference_id, F.concat(F.lit("page-"), F.lpad(page_number.cast("string"), 4, "0"), F.lit(".png")))


def viewer_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages as for page_issues. (a row for each reference with its pages by number, issues of the pages)."""
    about = [c for c in pages.columns if c not in ("case_id", "reference_id")]
    ordered = F.array_sort(F.collect_list(F.struct("page_number", *[c for c in about if c != "page_number"])))
    return pages.groupBy("case_id", "reference_id").agg(ordered.alias("pages")), page_issues(pages)


#: Effects of actions whose target must not have had the expected value before, and whose target's digest must change (fixed values).
NEW_VALUES, NEW_DIGESTS = ("paragraph-text", "table-cell-text"), ("paragraph-text", "text-style", "paragraph-style")


def postcondition_issue(effect: Column, expected: Column, before: Column, after: Column, before_digest: Column, after_digest: Column) -> Column:
    """What is wrong with an action's effect; null where it holds: the target has the expected value, didn't have it, and changed."""
    return (
        F.when(after.isNull(), "not-observed").when(~after.eqNullSafe(expected), "unexpected").when(effect.isin(*NEW_VALUES) & before.eqNullSafe(expected), "already")
        .when(effect.isin(*NEW_DIGESTS) & before_digest.eqNullSafe(after_digest), "unchanged")
    )
