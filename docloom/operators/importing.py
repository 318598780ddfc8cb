"""Raw import: file names to records, records to modules, modules to a folder plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import codes, rules
from docloom.functions.similarity import ratio_bound, seq_ratio
from docloom.functions.text import any_of, col, like, pytrim, sanitize

#: P20 to P25: patterns of raw file names. Fixed values.
TRIPLE = r"(?iuU)^(\d{3})[.\-](\d{2})[.\-](\d{2})"
DESCRIPTION = TRIPLE + r"\s+(?:описани\S*|обратный\s+клапан)\s*(.*?)\s*(?:!)?\s*\.(?:docx?!?\.)?(docx?|pdf)$"
CARD = TRIPLE + r"\s+ТК\s*(\d+)\s*(.*?)\s*(?:!)?\.(docx?|pdf)$"
GRAPHIC = r"(?iuU)^0?(\d{2,3})[.\-](\d{2})[.\-](\d{2})\s+(?:рисунок|рис)\s*(\d+)\s*(.*?)\s*(?:!)?\.(cdr|jpg|png)$"
FAULT_GRAPHIC = TRIPLE + r"\s+ПИУН\s+рис\s*(\d+).*\.(cdr|jpg|png)$"
PLAIN = TRIPLE + r"\s*\.(docx?|pdf)$"
TABLE = TRIPLE + r"\s+Таблица\s*(\d+).*\.(docx?|pdf)$"
MAINTENANCE = r"(?iuU)^\d{3}\.\d{2}\.\d{2}\s+ТК\s+ТО\b"


def junk(name: Column | str) -> Column:
    """Temporary and system files."""
    n = col(name)
    return n.startswith("~$") | n.startswith("~WRL") | F.lower(n).isin("thumbs.db", "desktop.ini") | n.endswith(".tmp")


def work_name(text: Column | str) -> Column:
    """The name of the work in the joined text of a card's boxes, up to the labour or the end; '' without one."""
    return pytrim(F.regexp_extract(col(text), r"(?sU)[Нн]аименование\s+работы\s*(.+?)(?:[Тт]рудо[её]мкость|$)", 1))


def _record(name: Column, pattern: str, kind: str, title: Column, special: Column | None = None, card: Column | None = None) -> Column:
    code = [F.regexp_extract(name, pattern, i) for i in (1, 2, 3)]
    return F.struct(
        F.lpad(code[0], 3, "0").alias("sys"), code[1].alias("sub"), code[2].alias("comp"), F.lit(kind).alias("doc_type"),
        (F.lit(None) if card is None else card).cast("bigint").alias("tk_number"), pytrim(title).alias("title"), (F.lit(None) if special is None else special).cast("string").alias("special_type"),
    )


def scan_files(files: DataFrame) -> DataFrame:
    """Rows (file_seq, role, filename) to source records; files that match nothing are dropped.

    Roles: desc, tech, graphics and root, as folders of a type-organised tree have them, and component for a component folder.
    The tests of a role run in order, the first that matches decides, as one expression per row: no joins, no loops.
    """
    n, low = F.col("filename"), F.lower("filename")

    def g(p: str, i: int) -> Column:
        return F.regexp_extract(n, p, i)

    fault = n.contains("ПИУН") & ~like(n, "(?iu)рис")
    office = like(n, r"(?i)\.(docx?)$")
    office_pdf = like(n, r"(?i)\.(docx?|pdf)$")
    fault_record = F.struct(
        F.lit("029").alias("sys"), F.lit("00").alias("sub"), F.lit("00").alias("comp"), F.lit("piun").alias("doc_type"), F.lit(None).cast("bigint").alias("tk_number"),
        F.lit("ПИУН").alias("title"), F.lit("piun").alias("special_type"),
    )
    description = _record(n, DESCRIPTION, "description", g(DESCRIPTION, 4))
    card = _record(n, CARD, "tk", g(CARD, 5), card=g(CARD, 4))
    maintenance = _record(n, TRIPLE, "tk_to", F.lit("ТК ТО"), F.lit("tk_to"))
    fault_graphic = _record(n, FAULT_GRAPHIC, "graphic", F.concat(F.lit("ПИУН рис "), g(FAULT_GRAPHIC, 4)), F.lit("piun_graphic"))
    graphic = _record(n, GRAPHIC, "graphic", F.concat(F.lit("рисунок "), g(GRAPHIC, 4), F.lit(" "), pytrim(g(GRAPHIC, 5))))
    table = _record(n, TABLE, "special", F.lit(""), F.lit("table"))
    plain = _record(n, PLAIN, "description", F.lit(""))
    short = _record(n, TRIPLE, "special", F.lit("Перечень принятых сокращений"), F.lit("abbreviations"))
    kind = F.lit(None).cast("string")
    for word, label in reversed(rules.ROOT_SPECIAL):
        kind = F.when(low.contains(word), label).otherwise(kind)
    rest = F.regexp_replace(F.regexp_replace(n, TRIPLE + r"\s+", ""), r"\.[^.]*$", "")
    special = _record(n, TRIPLE, "special", rest, kind)

    def first(*tests: tuple[Column, Column | None]) -> Column:
        out = None
        for hit, record in tests:
            record = F.lit(None) if record is None else record
            out = F.when(hit, record) if out is None else out.when(hit, record)
        return out

    desc = first((n.startswith("~$"), None), (fault & office, fault_record), (fault, None), (like(n, DESCRIPTION), description))
    tech = first((n.startswith("~$"), None), (like(n, MAINTENANCE) & office, maintenance), (like(n, MAINTENANCE), None), (like(n, CARD), card))
    drawn = first((like(n, FAULT_GRAPHIC), fault_graphic), (like(n, GRAPHIC), graphic))
    root = first((junk(n), None), (low.contains("перечень") & low.contains("сокращен") & like(n, TRIPLE), short), (low.contains("перечень") & low.contains("сокращен"), None), (like(n, TRIPLE + r"\s+") & office_pdf & kind.isNotNull(), special))
    own = first(
        (junk(n), None), (like(n, TRIPLE + r"\s+ТК\s+ТО\b") & office_pdf, maintenance), (like(n, TRIPLE + r"\s+ТК\s+ТО\b"), None), (fault & office_pdf, fault_record), (fault, None),
        (like(n, TABLE), table), (like(n, CARD), card), (like(n, DESCRIPTION), description), (like(n, PLAIN), plain),
    )
    role = F.col("role")
    made = F.when(role == "desc", desc).when(role == "tech", tech).when(role == "graphics", drawn).when(role == "root", root).when(role == "component", own)
    # The one-row generator keeps the optimizer from copying the expression into each of its fields.
    return files.select("file_seq", "filename", F.explode(F.array(made)).alias("_r")).where("_r IS NOT NULL").select("file_seq", "filename", "_r.*")


def folder_role(name: Column | str) -> Column:
    """What a top-level folder holds; drawings are tested before descriptions."""
    low = F.lower(col(name))
    return F.when(low.contains("рисунк"), "graphics").when(low.contains("описани"), "desc").when(low.contains("технолог"), "tech").when(like(name, r"^\d{3}\.\d{2}\.\d{2}$"), "component")


def mode(folders: DataFrame) -> DataFrame:
    """Component folders count only if no folder of a type exists. Adds used."""
    df = folders.withColumn("role", folder_role("name"))
    # One truth about all folders: a partial aggregate, of which one row reaches the driver.
    typed = bool(df.agg(F.bool_or(F.col("role").isin("graphics", "desc", "tech"))).first()[0])
    return df.withColumn("used", F.col("role").isNotNull() & (F.col("role").isin("graphics", "desc", "tech") | F.lit(not typed)))


def dedup_files(files: DataFrame) -> DataFrame:
    """Of .doc and .docx with one base name the last .doc stays, else the first .docx; other files pass.

    One aggregation with a map-side combine; ties by file_seq.
    """
    plain = F.col("filename").endswith(".doc")
    key = F.when(F.col("filename").endswith(".docx"), F.expr("left(filename, length(filename) - 1)")).when(plain, F.col("filename")).otherwise(F.concat(F.lit("\x00"), F.col("file_seq").cast("string")))
    rank = F.struct(plain.cast("int").alias("doc"), F.when(plain, F.col("file_seq")).otherwise(-F.col("file_seq")).alias("turn"))
    rows = files.withColumns({"_key": key, "_rank": rank, "_row": F.struct(*files.columns)})
    return rows.groupBy("_key").agg(F.max_by("_row", "_rank").alias("_row")).select("_row.*")


def component_names(docs: DataFrame) -> DataFrame:
    """name of each (sys, sub, comp): title of its first description with a title, else a generic name."""
    titled = F.when((F.col("doc_type") == "description") & (F.col("title") != ""), F.col("title"))
    first = F.min_by("title", F.when(titled.isNotNull(), F.struct("filename", "seq")))
    generic = F.when((F.col("sub") == "00") & (F.col("comp") == "00"), F.lit("Общие сведения")).otherwise(F.concat(F.lit("Компонент "), F.col("sub"), F.lit("-"), F.col("comp")))
    df = docs.groupBy("sys", "sub", "comp").agg(F.when(F.max(titled.isNotNull()), first).alias("_t"))
    return df.select("sys", "sub", "comp", F.coalesce("_t", generic).alias("name"))


def build_modules(docs: DataFrame) -> DataFrame:
    """Records to modules, with P32 to P34, A12, A14, O2, O3 and A22.

    A description or card gives one module, a table one, a list of abbreviations one, a maintenance card three, a fault list
    five. The variants of one component's equal codes are lettered in order.
    """
    named = docs.join(component_names(docs), ["sys", "sub", "comp"])
    df = codes.info_code(named)

    def module(assy, disassy, info, variant, component, name) -> Column:
        values = {"assy": assy, "disassy": disassy, "info": info, "variant": variant, "component_name": component, "info_name": name}
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])

    name, title = F.col("name"), F.col("title")
    described = codes.override("sys", "sub", "comp", F.lit("040"))
    info_names = F.when(codes.self_describing(name), "").when(F.col("comp") == "00", "Описание и принцип действия").when(title != "", "Описание устройства и принципа действия").otherwise("Описательный модуль данных")
    ruled = codes.override("sys", "sub", "comp", F.coalesce("code", F.lit("999")))
    assy = F.when(F.lower(title).contains("фильтроэлемент"), "01").otherwise("00")
    card_name = F.when(title == "", "Процедурный модуль данных").when(ruled.isin("920", "922"), "Демонтаж и монтаж").otherwise(title)
    generic = name.startswith("Компонент ") & (title != "")
    card = module(
        assy, "00", ruled, F.coalesce("variant", F.lit("A")), F.when(generic, title).when(assy == "00", name).otherwise(F.concat(F.lit("Фильтроэлемент "), name)), F.when(generic, "").otherwise(card_name)
    )
    table_name = F.when(title != "", title).otherwise(F.regexp_replace("filename", r"\.[^.]*$", ""))
    made = (
        F.when(F.col("doc_type") == "description", F.array(module("00", "00", described, "A", name, info_names)))
        .when(F.col("doc_type") == "tk", F.array(card))
        .when((F.col("doc_type") == "special") & (F.col("special_type") == "table"), F.array(module("00", "00", "040", "?", table_name, "")))
        .when((F.col("doc_type") == "special") & (F.col("special_type") == "abbreviations"), F.array(module("00", "00", "005", "A", name, "Перечень принятых сокращений")))
        .when(F.col("doc_type") == "tk_to", F.array(*[module("00", "00", c, v, name, n) for c, v, n in rules.CARD_MODULES]))
        .when(F.col("doc_type") == "piun", F.array(*[module("00", d, "420", "A", c, n) for d, c, n in rules.FAULT_MODULES]))
    )
    df = df.select("sys", "sub", "comp", "seq", "filename", "doc_type", F.posexplode(made).alias("_part", "_m"))
    df = df.select("sys", "sub", "comp", "seq", "filename", "doc_type", "_part", "_m.*")
    key = ["sys", "sub", "comp"]
    order = [F.col("doc_type") != "description", F.col("filename"), F.col("seq"), F.col("_part")]
    # A table takes the letter of the 040 modules before it.
    before = F.coalesce(F.sum((F.col("info") == "040").cast("int")).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    df = df.withColumn("_v", F.when(F.col("variant") == "?", before).otherwise(codes.letter_number(F.col("variant"))))
    # The n-th repetition takes the n-th letter after A, whatever its own letter; a code that is taken by then goes on after the last one.
    group = [*key, "assy", "disassy", "info"]
    again = F.row_number().over(Window.partitionBy(*group, "_v").orderBy("_place"))
    df = df.withColumn("_v", F.when(again == 1, F.col("_v")).otherwise(again - 1))
    taken = F.row_number().over(Window.partitionBy(*group, "_v").orderBy("_place")) > 1
    df = df.withColumn("_taken", taken.cast("int"))
    last = F.max("_v").over(Window.partitionBy(*group))
    turn = F.sum("_taken").over(Window.partitionBy(*group).orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("variant", codes.letters(F.when(F.col("_taken") == 1, last + turn).otherwise(F.col("_v"))))
    df = suppress_names(df)
    return df.withColumn("dmc", codes.module_string(*[F.col(c) for c in ("sys", "sub", "comp", "assy", "disassy", "info", "variant")])).drop("_part", "_place", "_v", "_taken")


def suppress_names(modules: DataFrame, least: float = 0.75) -> DataFrame:
    """info_name becomes empty where it is more than `least` like component_name, case aside. The ratio is computed once for each pair of
    names whose lengths allow it; at most 2 * shorter / (sum of lengths) characters can match.
    """
    a, b = F.lower("component_name"), F.lower("info_name")
    asked = modules.select(a.alias("_a"), b.alias("_b")).where((F.col("_a") != "") & (F.col("_b") != "") & (ratio_bound(F.col("_a"), F.col("_b")) > least)).distinct()
    alike = asked.where(seq_ratio(F.col("_a"), F.col("_b")) > least).withColumn("_alike", F.lit(True))
    out = modules.join(alike, (a == F.col("_a")) & (b == F.col("_b")), "left")
    return out.withColumn("info_name", F.when(F.col("_alike"), F.lit("")).otherwise(F.col("info_name"))).drop("_a", "_b", "_alike")


def attach_graphics(modules: DataFrame, graphics: DataFrame) -> DataFrame:
    """Fault graphics (special_type piun_graphic, number 101 up) go to the first module 420 of disassembly number - 100, others to the
    component's first module 040 or 042. Gives (sys, sub, comp, dmc, sources), sources in order of filename.
    """
    key = ["sys", "sub", "comp"]
    first = Window.partitionBy(*key, "disassy").orderBy("assy", "disassy", "info", "seq", "dmc")
    fault = modules.where("info = '420'").withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*key, "dmc", "disassy")
    plain = modules.where("info IN ('040', '042')").withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("assy", "disassy", "info", "seq", "dmc"))).where("_n = 1").select(*key, "dmc")
    number = F.regexp_extract("title", r"(?U)рис\s*(\d+)", 1).try_cast("int") - 100
    a = graphics.where("special_type = 'piun_graphic'").withColumn("disassy", F.lpad(number.cast("string"), 2, "0")).join(fault, [*key, "disassy"]).select(*key, "dmc", "filename")
    b = graphics.where("special_type IS NULL").join(plain, key).select(*key, "dmc", "filename")
    return a.unionByName(b).groupBy(*key, "dmc").agg(F.array_sort(F.collect_list("filename")).alias("sources"))


def folder_plan(modules: DataFrame, names: DataFrame) -> DataFrame:
    """K6: target folder of every module. A subsystem folder stands between only if the subsystem is not 00 and has several components."""
    subs = names.groupBy("sys", "sub").agg(F.count("*").alias("_n"), F.max_by("name", F.when(F.col("comp") == "00", F.lit(1))).alias("_s"), F.max((F.col("comp") == "00").cast("int")).alias("_has"))
    df = modules.join(names, ["sys", "sub", "comp"]).join(subs, ["sys", "sub"])
    middle = sanitize(F.concat("sys", F.lit("-"), "sub", F.lit(" - "), F.when((F.col("_has") == 1) & (F.col("_s") != ""), F.col("_s")).otherwise(F.concat(F.lit("Подсистема "), "sub"))))
    l1 = sanitize(F.concat("sys", F.lit("-"), "sub", F.lit("-"), "comp", F.lit(" - "), "name"))
    l2 = sanitize(F.concat(F.lit("["), "dmc", F.lit("] "), "component_name", F.when(F.col("info_name") != "", F.concat(F.lit(". "), "info_name")).otherwise("")))
    deep = (F.col("sub") != "00") & (F.col("_n") > 1)
    return df.select("dmc", "filename", "seq", F.when(deep, F.concat_ws("/", middle, l1, l2)).otherwise(F.concat_ws("/", l1, l2)).alias("folder"))
