"""Output labels the results must share with the reference (so reports read the same).

Fixed values, in the order they appear in a profiling run:
"""

ALL_GROUP = "All"                 # the overall row of the target summary
MISSING_CATEGORY = "Missing"      # NULL in category tables and top-N bars (merges with a real "Missing")
OTHER_CATEGORY = "Other"          # the rolled-up bar of top-N, and collapsed rare strata
LIST_SEPARATOR = " | "            # previews, similar-value groups, normalised groups
PREVIEW_PAIR = ": "               # "category: count" inside a preview
NORMALISED_MISSING = "missing"    # what the text normalisers return for NULL
UNKNOWN_STRATUM = "Unknown"       # NULL brand / stratum in strata and splits
NA_BIN = "<NA>"                   # NULL price bin label
PRICE_BIN_JOIN = "_price_bin_"    # brand + this + bin = stratum label
