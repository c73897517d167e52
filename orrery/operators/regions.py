"""Packs of a region: which organisations they hold for, platforms whose login they know, and addresses to try."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import rules, urls


@dataclass(frozen=True)
class Pack:
    name: str
    country: str
    suffixes: tuple[str, ...]  # of domains, with their dot
    probes: tuple[tuple[str, str, str], ...]  # label, category, path
    surfaces: tuple[tuple[str, str, str, str], ...]  # platform, category, patterns of host and of path; an empty one holds for none


# The pack of one country.
_PORTAL, _LMS = "Student Portal", "LMS/Moodle"
ARGENTINA = Pack(
    name="argentina",
    country="Argentina",
    suffixes=(".edu.ar", ".ar"),
    probes=(
        ("autogestion", _PORTAL, "/"), ("guarani", _PORTAL, "/"), ("siu", _PORTAL, "/"), ("g3w", _PORTAL, "/"), ("campus", _LMS, "/login/index.php"), ("campusvirtual", _LMS, "/login/index.php"),
        ("aulavirtual", _LMS, "/login/index.php"), ("virtual", _LMS, "/login/index.php"), ("moodle", _LMS, "/login/index.php"), ("alumnos", _PORTAL, "/"), ("estudiantes", _PORTAL, "/"), ("portal", _PORTAL, "/"),
        ("preinscripcion", _PORTAL, "/"), ("ingreso", _PORTAL, "/"),
    ),
    surfaces=(("SIU-Guaraní", _PORTAL, "guarani|autogestion", ""), ("SIU-Guaraní", _PORTAL, "", "/g3w|/acceso/login|/acceso$"), ("Moodle", _LMS, r"(^|\.)(campus|campusvirtual|aulavirtual|aula|virtual|moodle|eduvirtual)(\.|$)", "/login/index\\.php")),
)
PACKS = [ARGENTINA]


def region(domains: Column, country: Column, packs: list[Pack] = PACKS) -> Column:
    """The name of the first pack that holds for an organisation, by its domains or its country; null without one."""
    doms = F.filter(F.transform(F.coalesce(domains, F.array().cast("array<string>")), lambda d: F.ltrim(F.lower(F.trim(d)), F.lit("."))), lambda d: d != "")
    low = F.lower(F.trim(F.coalesce(country, F.lit(""))))
    by_suffix = lambda p: F.exists(doms, lambda d: d.isin(*[s.lstrip(".") for s in p.suffixes]) | d.rlike("(" + "|".join(s.replace(".", r"\.") for s in p.suffixes) + ")$"))
    return rules.first_of([(by_suffix(p) | (low == p.country.lower()), p.name) for p in packs])


def login_surface(url: Column, packs: list[Pack] = PACKS) -> Column:
    """The platform of a region whose login a url is, and its category (a struct); null if it is none.

    Where a surface has a pattern for host and path, both must hold.
    """
    host, path, out = urls.host(url), F.lower(urls.path(url)), None
    for platform, category, on_host, on_path in [s for p in packs for s in p.surfaces]:
        parts = [c.rlike(p) for c, p in ((host, on_host), (path, on_path)) if p]
        when, value = parts[0] if len(parts) == 1 else parts[0] & parts[1], F.struct(F.lit(platform).alias("platform"), F.lit(category).alias("category"))
        out = F.when(when, value) if out is None else out.when(when, value)
    return out if out is not None else F.lit(None).cast("struct<platform:string,category:string>")


def probes(df: DataFrame, *, org: str, domains: str, region: str, packs: list[Pack] = PACKS) -> DataFrame:
    """org, url, category and reason: each label of an organisation's pack before each of its domains, each address once."""
    tables = {p.name: F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("category"), F.lit(c).alias("path")) for a, b, c in p.probes]) for p in packs}
    found = None
    for name, table in tables.items():
        found = F.when(F.col(region) == name, table) if found is None else found.when(F.col(region) == name, table)
    own = df.select(org, F.col(region).alias("__region"), F.explode(domains).alias("__d"), found.alias("__probes")).withColumn("__d", F.ltrim(F.lower(F.trim("__d")), F.lit("."))).filter("__d <> ''")
    rows = own.select(org, "__region", "__d", F.explode("__probes").alias("p"))
    url = F.concat(F.lit("https://"), F.col("p.label"), F.lit("."), F.col("__d"), F.col("p.path"))
    reason = F.concat("__region", F.lit(" region probe: "), F.col("p.label"), F.lit("."), "__d")
    return rows.select(org, url.alias("url"), F.col("p.category").alias("category"), reason.alias("reason")).dropDuplicates([org, "url"])
