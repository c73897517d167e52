"""Discovery as one plan: all candidates go through all stages, each with the first stage that rejects it and why.

Stages are expressions over one row, so the whole ledger is one projection; only the last, the best of each host and
category, needs a shuffle. Nothing is dropped: whoever asks for what is left filters on a null stage, and counts
by stage come from one Observation of the same pass.

The rules read these columns of a candidate: url, host (see urls.host), category, password (a password field was seen), bypass (a known platform
already vouched for it), score and pos (its place, unique); and of its organisation: primary (main domain), domains,
extra_domains, extra_labels, extra_roots (arrays), state, exact (curated short names), auto (names drawn from its
domains), acronym, anchored (hosts that its home page links to as portals). Null arrays are empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import rules, sites, urls

# Platforms whose tenants are one organisation each, what stands before a tenant's name, names that
# many organisations share, tenants that are not for students, and home pages.
TENANT_ROOTS = ["samarth.edu.in", "samarth.ac.in"]
STATE_PLATFORMS = {"Bihar": ["bihar-ums.com"], "Maharashtra": ["digitaluniversity.ac", "digitaluniversity.ac.in", "mkcl.org"]}
FUNCTION_PREFIXES = [
    "lms-", "elearn-", "elearning-", "exam-", "examination-", "result-", "results-", "fee-", "fees-", "lib-", "library-", "admission-", "admissions-", "adm-", "cdoe-", "cde-", "ide-", "dde-", "sol-", "idol-", "ug-", "pg-",
    "distance-", "online-", "portal-", "student-", "students-", "app-",
]
AMBIGUOUS = ["mit", "iet", "iiit", "nit", "bit", "sit", "git"]
OTHER_TENANTS = ["rec", "recruit", "recruitment", "bharti", "admission", "admissions", "admissionportal"]
HOME_PATHS = ["", "/index.html", "/index.htm", "/index.php", "/home", "/default.aspx", "/default.htm", "/default.html"]
STRONG_PATHS = ["/login", "/signin", "/sign/", "/auth"]
LEAST_NAME = 4  # characters of a name that may be looked for inside others


@dataclass(frozen=True)
class Policy:
    """The lists of a deployment; all are sent with the plan."""

    shared: list[str]  # roots of platforms that many organisations use
    blocked: list[str] = field(default_factory=list)  # hosts and their subdomains that are never a portal
    tenant_roots: list[str] = field(default_factory=lambda: TENANT_ROOTS)
    state_platforms: dict[str, list[str]] = field(default_factory=lambda: STATE_PLATFORMS)
    prefixes: list[str] = field(default_factory=lambda: FUNCTION_PREFIXES)
    ambiguous: list[str] = field(default_factory=lambda: AMBIGUOUS)
    other_tenants: list[str] = field(default_factory=lambda: OTHER_TENANTS)
    labels: list[str] = field(default_factory=list)  # of subdomains that serve a whole organisation
    college_words: list[str] = field(default_factory=lambda: sites.COLLEGE_WORDS)

    @property
    def all_states(self) -> list[str]:
        return [root for roots in self.state_platforms.values() for root in roots]


def _names(c: str) -> Column:
    """An array of names, trimmed and lower case, without empty ones."""
    return F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def _root(host: Column, roots: Column) -> Column:
    """The first of the roots that a host is or is below; null without one."""
    return F.try_element_at(F.filter(roots, lambda r: (host == r) | F.endswith(host, F.concat(F.lit("."), r))), F.lit(1))


def _before(host: Column, root: Column) -> Column:
    """What stands before a root in a host."""
    return F.substr(host, F.lit(1), F.greatest(F.length(host) - F.length(root) - 1, F.lit(0)))


def membership(df: DataFrame, policy: Policy, into: str = "member") -> DataFrame:
    """df with why a host belongs to its organisation or not: a struct of ok and rule. The first rule that applies decides.

    A host on a platform of another state never belongs. On a platform of the own state, or of tenants, the tenant
    decides alone: a name of the organisation (the curated ones, else those drawn from its domains; its acronym too), as the
    whole tenant, its last label or what follows a prefix of function; or a name of four letters or more inside it. Else own
    domains and what is below them; hosts that the home page links to; a name of four letters or more that begins the registrable
    domain or is a label of the host; platforms that many share.
    """
    h = F.lower(F.col("host"))
    states = F.create_map(*[x for k, v in policy.state_platforms.items() for x in (F.lit(k), F.lit(v))]) if policy.state_platforms else None
    own_roots = F.coalesce(F.try_element_at(states, F.coalesce("state", F.lit(""))), F.array().cast("array<string>")) if states is not None else F.array().cast("array<string>")
    parts = df.withColumns({"__h": h, "__own": own_roots, "__exact": _names("exact"), "__auto": _names("auto"), "__acronym": F.lower(F.trim(F.coalesce("acronym", F.lit(""))))})
    host, acronym = F.col("__h"), F.col("__acronym")
    foreign = F.size(F.filter(F.lit(policy.all_states), lambda r: ~F.array_contains(F.col("__own"), r) & ((host == r) | F.endswith(host, F.concat(F.lit("."), r))))) > 0 if policy.all_states else F.lit(False)
    parts = parts.withColumns({"__foreign": foreign, "__root": _root(host, F.concat(F.col("__own"), F.lit(policy.tenant_roots)))})
    usable = ~acronym.isin(*policy.ambiguous)
    names = F.when(F.size("__exact") > 0, F.col("__exact")).otherwise(F.col("__auto"))
    names = F.when((F.length(acronym) >= LEAST_NAME) & usable, F.array_union(names, F.array(acronym))).otherwise(names)
    siblings = F.array_union(F.col("__exact"), F.filter("__auto", lambda s: ~s.isin(*policy.ambiguous)))
    siblings = F.when((acronym != "") & usable, F.array_union(siblings, F.array(acronym))).otherwise(siblings)
    parts = parts.withColumns({"__prefix": _before(host, F.col("__root")), "__names": names, "__siblings": siblings, "__base": F.substring_index(urls.registrable(host), ".", 1)})
    prefix = F.col("__prefix")
    after = F.transform(F.filter(F.lit(policy.prefixes), lambda p: F.startswith(prefix, p) & (F.length(prefix) > F.length(p))), lambda p: F.substr(prefix, F.length(p) + 1))
    tokens = F.concat(F.array(prefix, F.substring_index(prefix, ".", -1)), after)
    within = F.exists("__names", lambda s: (F.length(s) >= LEAST_NAME) & F.contains(prefix, s))
    owned = F.concat(F.array(F.lower(F.coalesce("primary", F.lit("")))), _names("domains"), _names("extra_domains"))
    mine = _root(host, F.filter(owned, lambda d: d != ""))
    sibling = F.exists("__siblings", lambda s: (F.length(s) >= LEAST_NAME) & (F.startswith(F.col("__base"), s) | F.contains(host, F.concat(F.lit("."), s, F.lit(".")))))
    on = F.col("__root").isNotNull()
    steps = [
        (F.coalesce(host, F.lit("")) == "", False, "no host"), (F.col("__foreign"), False, "platform of another state"), (on & (host == F.col("__root")), False, "bare platform"), (on & (F.size("__names") == 0), False, "no names for the tenant"),
        (on & F.arrays_overlap(tokens, F.col("__names")), True, "tenant"), (on & within, True, "name within the tenant"), (on, False, "another tenant"), (host == mine, True, "own domain"), (mine.isNotNull(), True, "below an own domain"),
        (F.array_contains(_names("anchored"), host), True, "linked from the home page"), (sibling, True, "name in the domain"), (urls.under(host, policy.shared), True, "shared platform"),
    ]
    rule = rules.first_of([(when, name) for when, _, name in steps], "mismatch")
    accepted = [name for _, ok, name in steps if ok]
    return parts.withColumn("__rule", rule).withColumn(into, F.struct(F.col("__rule").isin(*accepted).alias("ok"), F.col("__rule").alias("rule"))).drop(*[c for c in parts.columns if c.startswith("__")], "__rule")


def subdomain_rule(policy: Policy) -> Column:
    """Why the labels below an organisation's domain speak against a host, or null. Without any such domain the host is off.

    Shared platforms and the organisation's extra roots pass. Each label between host and domain must be one that serves a
    whole organisation, or none that names a college.
    """
    h = F.lower(F.col("host"))
    root = _root(h, F.concat(F.array(F.lower(F.coalesce("primary", F.lit("")))), _names("domains")))
    labels = F.filter(F.split(_before(h, root), r"\."), lambda x: x != "")
    extra = _names("extra_labels")
    offends = lambda x: ~x.isin(*policy.labels) & ~F.array_contains(extra, x) & sites.college_label(x, policy.college_words)
    passes = urls.under(h, policy.shared) | _root(h, _names("extra_roots")).isNotNull()
    return F.when(passes, F.lit(None)).when(root.isNull(), F.lit("off domain")).when(F.exists(labels, offends), F.concat(F.lit("labels: "), F.array_join(F.filter(labels, offends), ",")))


def strong_signal() -> Column:
    """A password field, a host below the main domain and a login path outweigh the labels."""
    return F.col("password") & (F.col("primary") != "") & F.endswith(F.lower(F.col("host")), F.concat(F.lit("."), F.lower(F.col("primary")))) & rules.contains_any(F.lower(urls.path(F.col("url"))), STRONG_PATHS)


def vetoes(policy: Policy) -> list[tuple[str, Column]]:
    """The stages of consolidation but the last, in order, each with its reason or null. They read `member` too."""
    h, url, primary = F.lower(F.col("host")), F.col("url"), F.lower(F.coalesce("primary", F.lit("")))
    some = lambda when, why: F.when(F.coalesce(when, F.lit(False)), F.lit(why))
    roots = F.lit([*policy.tenant_roots, *policy.all_states])
    root = _root(h, roots)
    tenant = F.substring_index(_before(h, root), ".", -1)
    other = F.exists(F.lit(policy.other_tenants), lambda s: F.endswith(tenant, s))
    own, there = urls.country(primary), urls.country(h)
    abroad = (own != "Global") & (there != "Global") & (own != there) & (urls.registrable(h) != urls.registrable(primary))
    path = F.lower(urls.without_trailing(urls.path(url)))
    home = (primary != "") & (h == F.regexp_replace(primary, r"^www\.", "")) & path.isin(*HOME_PATHS) & ~F.coalesce("password", F.lit(False))
    trusted = F.coalesce("bypass", F.lit(False)) & root.isNull()
    return [
        ("admin page", some(sites.admin_path(url), "admin path")),
        ("blocklist", some(urls.under(h, policy.blocked), "blocked host")),
        ("other tenant", some(root.isNotNull() & other, "tenant not for students")),
        ("country", F.when(abroad, F.concat(there, F.lit(" for "), own))),
        ("home page", some(home, "home page without login")),
        ("membership", F.when(~trusted & ~F.col("member.ok"), F.col("member.rule"))),
        ("labels", F.when(~F.coalesce(strong_signal(), F.lit(False)), subdomain_rule(policy))),
    ]


def ledger(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """df with the first stage that rejects a row, and its reason; both null where none does."""
    found = F.coalesce(*[F.when(reason.isNotNull(), F.struct(F.lit(name).alias("stage"), reason.alias("reason"))) for name, reason in stages])
    return df.withColumn("__found", found).withColumns({"stage": F.col("__found.stage"), "reason": F.col("__found.reason")}).drop("__found")


def settled(df: DataFrame, *, stage: str = "duplicate") -> DataFrame:
    """A ledger in which, of the rows that no stage rejected, one of each organisation, host and category is left.

    The best score wins, then the shorter path, then the later row. Rejected rows take no part; they keep a place
    of their own in the window, so that a host with many of them is no hot key.
    """
    live = F.col("stage").isNull()
    order = Window.partitionBy("orgid", "__host", "category", "__apart").orderBy(F.col("score").desc(), F.length(urls.without_trailing(urls.path(F.col("url")))), F.col("pos").desc())
    keyed = df.withColumns({"__host": urls.base_host(F.col("url")), "__apart": F.when(~live, F.col("pos"))}).withColumn("__n", F.row_number().over(order))
    lost = live & (F.col("__n") > 1)
    out = keyed.withColumns({"reason": F.when(lost, F.lit("better one of its host and category")).otherwise(F.col("reason")), "stage": F.when(lost, F.lit(stage)).otherwise(F.col("stage"))})
    return out.drop("__host", "__apart", "__n")


def observed(df: DataFrame, stages: list[str], seen: Observation) -> DataFrame:
    """df, with the number of rows of each stage, and of those left, in an Observation once it has been written.

    A global sort behind it would count rows twice, as it reads its input twice.
    """
    counts = [F.count_if(F.col("stage") == s).alias(s) for s in stages]
    return df.observe(seen, F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("stage").isNull()).alias("kept"), *counts)


def consolidated(df: DataFrame, policy: Policy, before: list[tuple[str, Column]] = (), seen: Observation | None = None) -> DataFrame:
    """All candidates with stage and reason: the stages `before`, the vetoes, and the best of each host and category. pos is unique."""
    stages = [*before, *vetoes(policy)]
    out = settled(ledger(membership(df, policy), stages))
    return observed(out, [name for name, _ in stages] + ["duplicate"], seen) if seen is not None else out
