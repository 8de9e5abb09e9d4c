"""Code tables, thresholds and labels of the reports."""

import math

TYPE_LABELS = {1: "Extrasystemic", 2: "Interstate", 3: "Internal", 4: "Internationalized Internal"}
ISSUE_LABELS = {1: "Dispute over Territory", 2: "Dispute over Government", 3: "Dispute over both"}
ISSUE_ORDER = ["Dispute over Government", "Dispute over Territory", "Dispute over both"]
REGION_LABELS = {1: "Europe", 2: "Middle East", 3: "Asia", 4: "Africa", 5: "Americas"}

DURATION_LIMIT = 11
DURATION_SHORT = "Less than 11 Conflict Years"
DURATION_LONG = "Greater than 11 Conflict Years"
DURATION_ORDER = [DURATION_SHORT, DURATION_LONG]

SEVERITY_LADDER = [
    (11236, "Greater than 11,236 deaths"),
    (1114, "Between 1,114 and 11,236 deaths"),
    (116, "Between 116 and 1,114 deaths"),
]
SEVERITY_LOWEST = "Fewer than 116 deaths"

WEALTH_LADDER = [
    (5342, "$5,342 - $27,674 GDP per capita"),
    (2116, "$2,116 - $5,342 GDP per capita"),
    (1228, "$1,228 - $2,116 GDP per capita"),
]
WEALTH_LOWEST = "$511 - $1,228 GDP per capita"

LEVEL_LADDER = [
    (10, "Ten Alliances"), (9, "Nine Alliances"), (8, "Eight Alliances"), (7, "Seven Alliances"),
    (6, "Six Alliances"), (5, "Five Alliances"), (4, "Four Alliances"), (3, "Three Alliances"),
    (2, "Two Alliances"),
]
LEVEL_LOWEST = "One Alliance"

SEVERITY_BREAKS = [-math.inf, 100, 1000, 5000, math.inf]
SEVERITY_BINS = ["less than 100", "100-1000", "1000-5000", "greater than 5000"]

RIDGE_GRID = (-2, 10, 200)
LASSO_GRID = (-3, 3, 200)
LASSO_CLASS_GRID = (-2, 10, 200)
RATE_GRID = (-10, -0.1, 20)
LINEAR_COSTS = [0.01, 0.1, 1, 5, 10]
RADIAL_COSTS = [0.01, 0.1, 1, 5, 10, 50, 100, 200, 500]
RADIAL_GAMMAS = (0.1, 10, 5)
POLY_COSTS = [0.1, 1, 10, 50, 100, 500]
POLY_DEGREES = [2, 3, 4, 5]
