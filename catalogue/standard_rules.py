"""The routing rules that the queries and tests are held against.  All names, prefixes and layers below are fixed values."""

from __future__ import annotations

from docweave.operators.routing import Condition, Destination, Rule
from docweave.sources.notifications import CURATED_LAYER as C
from docweave.sources.notifications import REALTIME_LAYER as R

DIRECT_SOURCES = ("Zeus", "Whatsapp", "Posv", "NeoProposal", "mquote")

BULK_SUFFIXES = (
    "",
    "_1",
    "_2",
    "_3",
    "_4",
    "_5",
    "_6",
    "_COVERAGEDETAILS",
    "_POLICYMESURES",
    "_BASEATTRIBUTES",
    "_POLICYBASICDETAILS",
    "_CLIENTPOLICYRELATIONSHIP",
)

REQUIREMENTS = (
    "BASEATTRIBUTES",
    "ACCOUNTDETAIL",
    "CLIENTPOLICYRELATIONSHIP",
    "BASEADDDETAIL",
    "COVERAGEDETAILS",
    "POLICYMESURES",
    "BONUSDETAILS",
    "PARTWITHDRWLDETAILS",
    "PAYMENTHISTORYDTLS",
    "LOANDETAIL",
    "CREDITCARDDETAIL",
    "POLICYBASICDETAILS",
    "NOMINEEDETAILS",
)

LAYERS = (("rdh", R), ("curated", C), ("rds", R))


def standard_rules(curated_arn: str) -> tuple[Rule, ...]:
    """The rules; ``curated_arn`` names the bucket whose files are curated already."""
    qlik_curated = (Destination("qlik/curated", "{x2}/{m4}", "{x6}.csv", C),)
    return (
        Rule(
            "R1",
            True,
            (Condition("arn", "eq", (curated_arn,)),),
            (Destination("curatedSourceData", "{x2}/{x3}", "{x4}.parquet", C),),
        ),
        Rule(
            "R2",
            True,
            (Condition("x1", "eq", DIRECT_SOURCES),),
            (
                Destination("rdh", "{x2}", "{x7}.csv", R),
                Destination("rdh", "{x2}-rider", "{x7}.csv", R),
                Destination("curated", "{x2}", "{x7}.csv", C),
                Destination("rds", "{x2}", "{x7}.csv", R),
            ),
        ),
        Rule(
            "R3",
            True,
            (Condition("x1", "eq_ci", ("telemer",)),),
            tuple(
                Destination(layer, "{x2}/{x3}/" + kind, "{x8}.csv", payload)
                for kind in ("base", "mdchck")
                for layer, payload in LAYERS
            ),
        ),
        Rule(
            "R4",
            True,
            (Condition("x0", "eq_ci", ("rds_src_data_1",)),),
            tuple(Destination("rdh", "{x2}/{x3}" + suffix, "{sequencer}.csv", R) for suffix in BULK_SUFFIXES),
        ),
        Rule(
            "R5",
            True,
            (Condition("x3", "prefix", ("MLI_Schema",)), Condition("x1", "eq", ("msales",))),
            (Destination("qlik/curated", "{t0}/{t1}", "{x4}.csv", C),),
        ),
        Rule(
            "R6",
            True,
            (Condition("x3", "prefix", ("SCOPP", "SMSUSER")),),
            (Destination("qlik/curated", "{x2}/{m3}", "{x5}.csv", C),),
        ),
        Rule(
            "R7a",
            False,
            (Condition("x4", "prefix", ("KCAPUAT3", "MNYLMIG")),),
            (
                *(Destination("qlik/" + layer, "{x2}/{m4}", "{x6}.csv", payload) for layer, payload in LAYERS),
                *(Destination("qlik/rdh", "{x2}/{m4}_" + name, "{x6}.csv", R) for name in REQUIREMENTS),
            ),
        ),
        Rule("R7b", False, (Condition("x4", "prefix", ("dbo",)),), qlik_curated),
        Rule("R7c", False, (Condition("x4", "prefix", ("SMSUSER", "RENOVAPRODIND")),), qlik_curated),
        Rule(
            "R7d",
            False,
            (Condition("x1", "prefix", ("daksh",)),),
            (Destination("qlik/curated", "", "{x5}.csv", C),),
        ),
        Rule(
            "R7e",
            False,
            (),
            (
                *(Destination("rdh", "{x2}/{x3}_" + name, "{x8}.csv", R) for name in REQUIREMENTS),
                *(Destination(layer, "{x2}/{x3}", "{x8}.csv", payload) for layer, payload in LAYERS),
            ),
        ),
    )
