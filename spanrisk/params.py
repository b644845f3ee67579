"""Fixed values of the risk model.

Everything in this module is a fact the results depend on: lookup tables,
weights, thresholds and calibration constants. They are kept together, in
natural order, so that another inventory (or another year) can override them
through the dataclasses below instead of editing operator code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

# --------------------------------------------------------------------------
# FIXED VALUES — raw item names of the delimited inventory and their friendly
# names (natural order of the record format).
# --------------------------------------------------------------------------
RENAME_MAP: dict[str, str] = {
    "STATE_CODE_001": "STATE_CODE",
    "STRUCTURE_NUMBER_008": "STRUCTURE_NUMBER",
    "RECORD_TYPE_005A": "RECORD_TYPE",
    "ROUTE_PREFIX_005B": "ROUTE_PREFIX",
    "SERVICE_LEVEL_005C": "SERVICE_LEVEL",
    "ROUTE_NUMBER_005D": "ROUTE_NUMBER",
    "DIRECTION_005E": "DIRECTION_SUFFIX",
    "HIGHWAY_DIST_002": "HIGHWAY_DISTRICT",
    "COUNTY_CODE_003": "COUNTY_CODE",
    "PLACE_CODE_004": "PLACE_CODE",
    "FEATURES_DESC_006A": "FEATURES_INTERSECTED",
    "CRITICAL_FACILITY_006B": "CRITICAL_FACILITY",
    "FACILITY_CARRIED_007": "FACILITY_CARRIED",
    "LOCATION_009": "LOCATION",
    "MIN_VERT_CLR_010": "MIN_VERT_CLR_010",
    "KILOPOINT_011": "KILOPOINT",
    "BASE_HWY_NETWORK_012": "BASE_HWY_NETWORK",
    "LRS_INV_ROUTE_013A": "LRS_INV_ROUTE",
    "SUBROUTE_NO_013B": "SUBROUTE_NO",
    "LAT_016": "LATITUDE",
    "LONG_017": "LONGITUDE",
    "DETOUR_KILOS_019": "DETOUR_KILOS",
    "TOLL_020": "TOLL",
    "MAINTENANCE_021": "MAINTENANCE_RESP",
    "OWNER_022": "OWNER",
    "FUNCTIONAL_CLASS_026": "FUNCTIONAL_CLASS",
    "YEAR_BUILT_027": "YEAR_BUILT",
    "TRAFFIC_LANES_ON_028A": "LANES_ON",
    "TRAFFIC_LANES_UND_028B": "LANES_UNDER",
    "ADT_029": "ADT",
    "YEAR_ADT_030": "YEAR_ADT",
    "DESIGN_LOAD_031": "DESIGN_LOAD",
    "APPR_WIDTH_MT_032": "APPR_WIDTH",
    "MEDIAN_CODE_033": "MEDIAN_CODE",
    "DEGREES_SKEW_034": "DEGREES_SKEW",
    "STRUCTURE_FLARED_035": "STRUCTURE_FLARED",
    "RAILINGS_036A": "RAILINGS",
    "TRANSITIONS_036B": "TRANSITIONS",
    "APPR_RAIL_036C": "APPR_RAIL",
    "APPR_RAIL_END_036D": "APPR_RAIL_END",
    "HISTORY_037": "HISTORICAL_SIGNIF",
    "NAVIGATION_038": "NAVIGATION_CTRL",
    "NAV_VERT_CLR_MT_039": "NAV_VERT_CLR",
    "NAV_HORR_CLR_MT_040": "NAV_HORIZ_CLR",
    "OPEN_CLOSED_POSTED_041": "OPEN_CLOSED_POSTED",
    "SERVICE_ON_042A": "SERVICE_ON",
    "SERVICE_UND_042B": "SERVICE_UNDER",
    "STRUCTURE_KIND_043A": "MATERIAL_KIND",
    "STRUCTURE_TYPE_043B": "DESIGN_TYPE",
    "APPR_KIND_044A": "APPR_MATERIAL",
    "APPR_TYPE_044B": "APPR_DESIGN",
    "MAIN_UNIT_SPANS_045": "MAIN_SPANS",
    "APPR_SPANS_046": "APPR_SPANS",
    "HORR_CLR_MT_047": "HORZ_CLR",
    "MAX_SPAN_LEN_MT_048": "MAX_SPAN_LEN",
    "STRUCTURE_LEN_MT_049": "STRUCTURE_LEN",
    "LEFT_CURB_MT_050A": "LEFT_CURB",
    "RIGHT_CURB_MT_050B": "RIGHT_CURB",
    "ROADWAY_WIDTH_MT_051": "ROADWAY_WIDTH",
    "DECK_WIDTH_MT_052": "DECK_WIDTH",
    "VERT_CLR_OVER_MT_053": "VERT_CLR_OVER",
    "VERT_CLR_UND_REF_054A": "VERT_CLR_UND_REF",
    "VERT_CLR_UND_054B": "VERT_CLR_UND",
    "LAT_UND_REF_055A": "LAT_UND_REF",
    "LAT_UND_MT_055B": "LAT_UND",
    "LEFT_LAT_UND_MT_056": "LEFT_LAT_UND",
    "DECK_COND_058": "DECK_COND",
    "SUPERSTRUCTURE_COND_059": "SUPERSTR_COND",
    "SUBSTRUCTURE_COND_060": "SUBSTR_COND",
    "CHANNEL_COND_061": "CHANNEL_COND",
    "CULVERT_COND_062": "CULVERT_COND",
    "OPR_RATING_METH_063": "OPR_RATING_METH",
    "OPERATING_RATING_064": "OPERATING_RATING",
    "INV_RATING_METH_065": "INV_RATING_METH",
    "INVENTORY_RATING_066": "INVENTORY_RATING",
    "STRUCTURAL_EVAL_067": "STRUCT_EVAL",
    "DECK_GEOMETRY_EVAL_068": "DECK_GEOM_EVAL",
    "UNDCLRENCE_EVAL_069": "UNDCLR_EVAL",
    "POSTING_EVAL_070": "BRIDGE_POSTING",
    "WATERWAY_EVAL_071": "WATERWAY_EVAL",
    "APPR_ROAD_EVAL_072": "APPR_ROAD_EVAL",
    "WORK_PROPOSED_075A": "WORK_PROPOSED",
    "WORK_DONE_BY_075B": "WORK_DONE_BY",
    "IMP_LEN_MT_076": "IMP_LEN",
    "DATE_OF_INSPECT_090": "INSPECT_DATE",
    "INSPECT_FREQ_MONTHS_091": "INSPECT_FREQ",
    "FRACTURE_092A": "FRACTURE",
    "UNDWATER_LOOK_SEE_092B": "UNDERWATER_INSP",
    "SPEC_INSPECT_092C": "SPEC_INSPECT",
    "FRACTURE_LAST_DATE_093A": "FRACTURE_DATE",
    "UNDWATER_LAST_DATE_093B": "UNDERWATER_DATE",
    "SPEC_LAST_DATE_093C": "SPEC_DATE",
    "BRIDGE_IMP_COST_094": "BRIDGE_IMP_COST",
    "ROADWAY_IMP_COST_095": "ROADWAY_IMP_COST",
    "TOTAL_IMP_COST_096": "TOTAL_IMP_COST",
    "YEAR_OF_IMP_097": "YEAR_OF_IMP",
    "OTHER_STATE_CODE_098A": "BORDER_STATE",
    "OTHER_STATE_PCNT_098B": "BORDER_PCT",
    "OTHR_STATE_STRUC_NO_099": "BORDER_STRUC_NO",
    "STRAHNET_HIGHWAY_100": "STRAHNET_HWY",
    "PARALLEL_STRUCTURE_101": "PARALLEL_STRUCT",
    "TRAFFIC_DIRECTION_102": "TRAFFIC_DIR",
    "TEMP_STRUCTURE_103": "TEMP_STRUCTURE",
    "HIGHWAY_SYSTEM_104": "HWY_SYSTEM",
    "FEDERAL_LANDS_105": "FED_LANDS",
    "YEAR_RECONSTRUCTED_106": "YEAR_RECONSTRUCTED",
    "DECK_STRUCTURE_TYPE_107": "DECK_STRUCT_TYPE",
    "SURFACE_TYPE_108A": "SURFACE_TYPE",
    "MEMBRANE_TYPE_108B": "MEMBRANE_TYPE",
    "DECK_PROTECTION_108C": "DECK_PROTECTION",
    "PERCENT_ADT_TRUCK_109": "PCT_TRUCK",
    "NATIONAL_NETWORK_110": "NAT_NETWORK",
    "PIER_PROTECTION_111": "PIER_PROTECTION",
    "BRIDGE_LEN_IND_112": "BRIDGE_LEN_IND",
    "SCOUR_CRITICAL_113": "SCOUR_CRITICAL",
    "FUTURE_ADT_114": "FUTURE_ADT",
    "YEAR_OF_FUTURE_ADT_115": "YEAR_FUTURE_ADT",
    "MIN_NAV_CLR_MT_116": "MIN_NAV_CLR",
    "FED_AGENCY": "FED_AGENCY",
    "SUBMITTED_BY": "SUBMITTED_BY",
    "BRIDGE_CONDITION": "BRIDGE_CONDITION",
    "LOWEST_RATING": "LOWEST_RATING",
    "DECK_AREA": "DECK_AREA",
}

# FIXED VALUES — text that a delimited reader treats as missing: the blank and
# single-space tokens plus the usual spreadsheet/pandas missing markers.
NULL_TOKENS: tuple[str, ...] = (
    "", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# FIXED VALUES — columns coerced to numbers during cleaning.
NUMERIC_COLS: tuple[str, ...] = (
    "YEAR_BUILT", "ADT", "LANES_ON", "FUTURE_ADT", "STRUCTURE_LEN",
    "MAX_SPAN_LEN", "OPERATING_RATING", "INVENTORY_RATING", "PCT_TRUCK",
)
CONDITION_COLS: tuple[str, ...] = (
    "DECK_COND", "SUPERSTR_COND", "SUBSTR_COND", "CHANNEL_COND", "CULVERT_COND",
)
RATING_COLS: tuple[str, ...] = (
    "STRUCT_EVAL", "BRIDGE_POSTING", "SCOUR_CRITICAL", "WATERWAY_EVAL", "LOWEST_RATING",
)

# FIXED VALUES — scour criticality code (item 113) to base scour risk.
SCOUR_RISK_MAP: dict[int, float] = {
    0: 0.4, 1: 0.05, 2: 0.05, 3: 0.55, 4: 0.90,
    5: 0.75, 6: 0.65, 7: 1.00, 8: 0.80, 9: 1.00,
}
SCOUR_RISK_DEFAULT = 0.35

# FIXED VALUES — design load code (item 31) to reserve-capacity risk.
DESIGN_LOAD_RISK_MAP: dict[str, float] = {
    "0": 0.50, "1": 0.90, "2": 0.80, "3": 0.75, "4": 0.60, "5": 0.25,
    "6": 0.20, "7": 0.10, "8": 0.35, "9": 0.05, "A": 0.30, "B": 0.30, "C": 0.30,
}
DESIGN_LOAD_RISK_DEFAULT = 0.40

# FIXED VALUES — the 18 published feature names.
FEATURE_COLS: tuple[str, ...] = (
    "COND_RISK", "SUBSTR_RISK", "SUPER_RISK", "DECK_RISK", "AGE_NORM",
    "ADT_LOG_NORM", "ADT_AGE_STRESS", "LOAD_POSTED", "SCOUR_RISK",
    "FRACTURE_CRITICAL", "DESIGN_LOAD_RISK", "CHANNEL_RISK", "STRUCT_EVAL_RISK",
    "WATERWAY_RISK", "TRUCK_NORM", "TRUCK_LOAD_STRESS", "INSPECT_RISK", "IS_CLOSED",
)

# FIXED VALUES — the 12 model inputs that do not encode condition ratings.
ML_FEATURE_COLS: tuple[str, ...] = (
    "AGE_NORM", "ADT_LOG_NORM", "ADT_AGE_STRESS", "TRUCK_NORM",
    "TRUCK_LOAD_STRESS", "SCOUR_RISK", "LOAD_POSTED", "WATERWAY_RISK",
    "FRACTURE_CRITICAL", "DESIGN_LOAD_RISK", "INSPECT_RISK", "IS_CLOSED",
)

# FIXED VALUES — deficiency index weights (sum to 1.0).
SDI_WEIGHTS: dict[str, float] = {
    "COND_RISK": 0.30,
    "STRUCT_EVAL_RISK": 0.18,
    "SCOUR_RISK": 0.14,
    "FRACTURE_CRITICAL": 0.07,
    "DESIGN_LOAD_RISK": 0.06,
    "LOAD_POSTED": 0.06,
    "AGE_NORM": 0.07,
    "ADT_AGE_STRESS": 0.04,
    "TRUCK_LOAD_STRESS": 0.03,
    "CHANNEL_RISK": 0.02,
    "WATERWAY_RISK": 0.02,
    "INSPECT_RISK": 0.01,
    "IS_CLOSED": 0.00,
}

# FIXED VALUES — state FIPS code to name.
STATE_CODES: dict[str, str] = {
    "01": "Alabama", "02": "Alaska", "04": "Arizona", "05": "Arkansas",
    "06": "California", "08": "Colorado", "09": "Connecticut", "10": "Delaware",
    "11": "District of Columbia", "12": "Florida", "13": "Georgia", "15": "Hawaii",
    "16": "Idaho", "17": "Illinois", "18": "Indiana", "19": "Iowa",
    "20": "Kansas", "21": "Kentucky", "22": "Louisiana", "23": "Maine",
    "24": "Maryland", "25": "Massachusetts", "26": "Michigan", "27": "Minnesota",
    "28": "Mississippi", "29": "Missouri", "30": "Montana", "31": "Nebraska",
    "32": "Nevada", "33": "New Hampshire", "34": "New Jersey", "35": "New Mexico",
    "36": "New York", "37": "North Carolina", "38": "North Dakota", "39": "Ohio",
    "40": "Oklahoma", "41": "Oregon", "42": "Pennsylvania", "44": "Rhode Island",
    "45": "South Carolina", "46": "South Dakota", "47": "Tennessee", "48": "Texas",
    "49": "Utah", "50": "Vermont", "51": "Virginia", "53": "Washington",
    "54": "West Virginia", "55": "Wisconsin", "56": "Wyoming",
    "60": "American Samoa", "66": "Guam", "72": "Puerto Rico", "78": "U.S. Virgin Islands",
}

# FIXED VALUES — state FIPS code to postal abbreviation (50 states + DC).
FIPS_TO_ABBR: dict[str, str] = {
    "01": "AL", "02": "AK", "04": "AZ", "05": "AR", "06": "CA",
    "08": "CO", "09": "CT", "10": "DE", "11": "DC", "12": "FL",
    "13": "GA", "15": "HI", "16": "ID", "17": "IL", "18": "IN",
    "19": "IA", "20": "KS", "21": "KY", "22": "LA", "23": "ME",
    "24": "MD", "25": "MA", "26": "MI", "27": "MN", "28": "MS",
    "29": "MO", "30": "MT", "31": "NE", "32": "NV", "33": "NH",
    "34": "NJ", "35": "NM", "36": "NY", "37": "NC", "38": "ND",
    "39": "OH", "40": "OK", "41": "OR", "42": "PA", "44": "RI",
    "45": "SC", "46": "SD", "47": "TN", "48": "TX", "49": "UT",
    "50": "VT", "51": "VA", "53": "WA", "54": "WV", "55": "WI",
    "56": "WY",
}

# FIXED VALUES — codes left out of the contiguous-states region maps.
CONUS_SKIP: tuple[str, ...] = ("02", "15", "72", "78", "66", "60")

# FIXED VALUES — region (polygon) names of the public US-states boundary file:
# the 50 states, the District of Columbia and Puerto Rico.
REGION_NAMES: tuple[str, ...] = (
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware",
    "District of Columbia", "Florida", "Georgia", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa",
    "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota",
    "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey",
    "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon",
    "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah",
    "Vermont", "Virginia", "Washington", "West Virginia", "Wisconsin", "Wyoming", "Puerto Rico",
)

# FIXED VALUES — an outside ranking of states by share of poor bridges (top 10, published).
OUTSIDE_POOR_RANKING: tuple[str, ...] = (
    "Iowa", "West Virginia", "South Dakota", "Maine", "Puerto Rico",
    "Rhode Island", "Pennsylvania", "Louisiana", "North Dakota", "Michigan",
)

# FIXED VALUES — severity tiers, most severe first, with lower cut-offs.
TIERS: tuple[str, ...] = ("Critical", "High", "Medium", "Low")
TIER_CUTOFFS: tuple[tuple[str, float], ...] = (("Critical", 0.75), ("High", 0.50), ("Medium", 0.25))

# FIXED VALUES — condition code (0-9) to words, for map labels.
CONDITION_LABELS: dict[int, str] = {
    9: "Excellent", 8: "Very Good", 7: "Good", 6: "Satisfactory",
    5: "Fair", 4: "Poor", 3: "Serious", 2: "Critical",
    1: "Imminent Failure", 0: "Failed/Closed",
}
CATEGORY_LABELS: dict[str, str] = {"G": "Good", "F": "Fair", "P": "Poor"}

# FIXED VALUES — water keywords, matched as substrings of the upper-cased
# "features intersected" text.
WATER_WORDS: tuple[str, ...] = (
    "RIVER", "CREEK", "LAKE", "BAY", "OCEAN", "HARBOR", "CHANNEL", "STREAM", "BROOK",
    "BRANCH", "FORK", "POND", "RESERVOIR", "INLET", "SOUND", "STRAIT", "ESTUARY", "BAYOU",
    "SLOUGH", "CANAL", "WATERWAY", "SEA", "GULF", "COVE", "LAGOON",
)
# FIXED VALUES — whole-word variant (adds RUN); defined for completeness.
WATER_WORDS_STRICT: tuple[str, ...] = (
    "RIVER", "CREEK", "LAKE", "BAY", "OCEAN", "HARBOR", "CHANNEL", "STREAM", "BROOK", "RUN",
    "BRANCH", "FORK", "POND", "RESERVOIR", "INLET", "SOUND", "STRAIT", "ESTUARY", "BAYOU",
    "SLOUGH", "CANAL", "WATERWAY", "SEA", "GULF", "COVE", "LAGOON",
)

# FIXED VALUES — casualty base rates by (water crossing, span class).
FATALITY_RATES: dict[tuple[bool, str], float] = {
    (False, "short"): 0.08, (False, "medium"): 0.20, (False, "long"): 0.40,
    (True, "short"): 0.30, (True, "medium"): 0.50, (True, "long"): 0.70,
}
INJURY_RATES: dict[tuple[bool, str], float] = {
    (False, "short"): 0.70, (False, "medium"): 0.60, (False, "long"): 0.45,
    (True, "short"): 0.45, (True, "medium"): 0.35, (True, "long"): 0.22,
}


@dataclass(frozen=True)
class ModelParams:
    """Scoring parameters. Defaults are the published configuration."""

    current_year: int = 2024
    year_min: int = 1800
    year_max: int = 2025
    lat_min: float = 17.0
    lat_max: float = 72.0
    lon_min: float = -180.0
    lon_max: float = -60.0
    age_cap: float = 120.0
    age_default: float = 60.0
    age_power: float = 0.7
    adt_cap: float = 200_000.0
    cond_fill: float = 5.0
    channel_fill: float = 6.0
    inspect_cap_years: float = 5.0
    inspect_default: float = 0.5
    inspect_pivot_yy: int = 30
    sdi_weights: dict = field(default_factory=lambda: dict(SDI_WEIGHTS))
    min_positives: int = 100
    # gradient-boosted trees
    n_trees: int = 100
    max_depth: int = 4
    learning_rate: float = 0.1
    subsample: float = 0.8
    n_folds: int = 3
    seed: int = 42
    # fits submitted at once (fold fits + the full-data fit); 1 = one after another,
    # which bounds the cached training copies on very large inputs
    concurrent_fits: int = 4


@dataclass(frozen=True)
class ExposureParams:
    """Collapse-probability and occupancy parameters."""

    base_rate: float = 1.3e-5
    rate_at_one: float = 2.5e-3
    speed_free_kmh: float = 80.0
    speed_posted_kmh: float = 40.0
    peak_fraction: float = 0.10
    occ_car: float = 1.67
    occ_truck: float = 1.10
    default_len_m: float = 30.0
    min_len_m: float = 5.0
    max_len_m: float = 5000.0
    default_span_m: float = 20.0
    default_truck_pct: float = 10.0
    default_posting: float = 5.0
    posted_max_code: float = 3.0
    truck_fatality_premium: float = 0.15

    @property
    def k_exponent(self) -> float:
        return math.log(self.rate_at_one / self.base_rate)


DEFAULT_MODEL = ModelParams()
DEFAULT_EXPOSURE = ExposureParams()
