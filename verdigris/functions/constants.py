"""Fixed values.

Everything in this module is a FIXED VALUE that results depend on: emission
factors, global warming potentials, enumerations, lookup tables and literal
labels of the greenhouse-gas accounting method. They are stated once, in
natural order, and every operator reads them from here.
"""

from __future__ import annotations

# --- FIXED VALUES: global warming potentials (GWP100) -----------------------
GWP_CH4 = 29.8
GWP_N2O = 273.0

# --- FIXED VALUES: stationary combustion factors ----------------------------
# natural gas, kg per GJ
EF_NATGAS_CO2_PER_GJ = 56.10
EF_NATGAS_CH4_PER_GJ = 0.001
EF_NATGAS_N2O_PER_GJ = 0.0001
# diesel, kg per litre (code constants; the specification prints 2.6710 for CO2)
EF_DIESEL_CO2_PER_L = 2.53763
EF_DIESEL_CH4_PER_L = 0.0000097
EF_DIESEL_N2O_PER_L = 0.000121

# --- FIXED VALUES: grid emission factors, kg CO2 per kWh --------------------
GRID_EF = {
    "java_bali": 0.7250,
    "sumatra": 0.8020,
    "kalimantan": 0.8450,
    "sulawesi": 0.7900,
    "national": 0.7886,
}
GRID_EF_DEFAULT = 0.7886
GRID_REGION_DEFAULT = "national"

# --- FIXED VALUES: PCAF data-quality score -> confidence factor --------------
PCAF_CONFIDENCE = {
    1.0: 1.00,
    1.5: 0.95,
    2.0: 0.90,
    3.0: 0.75,
    4.0: 0.60,
    5.0: 0.45,
}
PCAF_CONFIDENCE_DEFAULT = 0.45

# --- FIXED VALUES: target distribution of PCAF scores (percent of loans) ----
PCAF_TARGET_PCT = {1.0: 3.5, 1.5: 1.5, 2.0: 15.0, 3.0: 30.0, 4.0: 35.0, 5.0: 15.0}

# --- FIXED VALUES: enumerations ----------------------------------------------
EF_SOURCES = ("PLN_Grid_Average_2023", "DEFRA_2025", "IPCC_AR6_CH4_GWP100")
DATA_SOURCES = ("smart_meter_api", "manual_entry", "estimate")
ENERGY_STATUSES = ("complete", "missing_primary", "excluded")
SECTORS = (
    "manufacturing_cement", "manufacturing_steel", "manufacturing_food",
    "real_estate_commercial", "real_estate_residential", "transportation_road",
    "agriculture", "energy_oil_gas", "financial_services", "retail_trade",
)
LOAN_TYPES = ("term_loan", "revolving_credit", "mortgage", "project_finance",
              "syndicated_loan", "leasing")
CURRENCIES = ("IDR", "USD")
LOAN_STATUSES = ("validated", "pending", "rejected")
PCAF_SCORES = (1.0, 1.5, 2.0, 3.0, 4.0, 5.0)

# --- FIXED VALUES: sector display names --------------------------------------
SECTOR_DISPLAY = {
    "manufacturing_cement": "Manufacturing - Cement",
    "manufacturing_steel": "Manufacturing - Steel",
    "manufacturing_food": "Manufacturing - Food & Beverage",
    "real_estate_commercial": "Real Estate - Commercial",
    "real_estate_residential": "Real Estate - Residential",
    "transportation_road": "Transportation - Road",
    "agriculture": "Agriculture",
    "energy_oil_gas": "Energy - Oil & Gas",
    "financial_services": "Financial Services",
    "retail_trade": "Retail Trade",
}

# --- FIXED VALUES: literal labels written into curated tables ---------------
SCOPE1_METHODOLOGY = "GHG_Protocol_Corporate_Standard_v2015"
SCOPE1_CONSOLIDATION = "operational_control"
SCOPE2_METHODOLOGY = "GHG_Protocol_Scope2_Guidance_2015"
ASSURANCE_LEVEL = "none"

# --- FIXED VALUES: statuses and thresholds -----------------------------------
ENERGY_OK_STATUS = "complete"
LOAN_OK_STATUS = "validated"
MAX_IMPUTED_MONTHS = 5          # more than this -> data quality score 4 -> rejected
USD_IDR_RATE = 15750.0          # reference rate, used only when converting USD rows
FRESHNESS_MAX_AGE_HOURS = 720
DQ_FIRST_YEAR, DQ_LAST_YEAR = 2020, 2035  # as published; test data lie before, so the rule reports them

# --- FIXED VALUES: test parameters of the fixture tables ---------------------
BANK_ID = "GENERIC_FI_001"
BASE_YEAR = 1995
CURRENT_YEAR = 2000
REVENUE_BASE_IDR_BN = 85000.0   # revenue(year) = 85000 + 1000 * (year - 1995), 1995..2000
REVENUE_STEP_IDR_BN = 1000.0
REVENUE_FIRST_YEAR = 1995
REVENUE_LAST_YEAR = 2000
