"""Explicit schemas of the three churn input tables.

Reading CSV with ``inferSchema`` costs a second pass over the data and can
disagree between files, so every reader takes one of these.  Dates stay
text here (as in the source files) and are parsed by ``functions.dates``.
"""

from pyspark.sql import types as T

_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()

CUSTOMER_COLUMNS = [
    ("id", _S), ("activity_new", _S), ("campaign_disc_ele", _S), ("channel_sales", _S),
    ("cons_12m", _D), ("cons_gas_12m", _D), ("cons_last_month", _D),
    ("date_activ", _S), ("date_end", _S), ("date_first_activ", _S),
    ("date_modif_prod", _S), ("date_renewal", _S),
    ("forecast_base_bill_ele", _D), ("forecast_base_bill_year", _D),
    ("forecast_bill_12m", _D), ("forecast_cons", _D), ("forecast_cons_12m", _D),
    ("forecast_cons_year", _D), ("forecast_discount_energy", _D),
    ("forecast_meter_rent_12m", _D), ("forecast_price_energy_p1", _D),
    ("forecast_price_energy_p2", _D), ("forecast_price_pow_p1", _D),
    ("has_gas", _S), ("imp_cons", _D), ("margin_gross_pow_ele", _D),
    ("margin_net_pow_ele", _D), ("nb_prod_act", _I), ("net_margin", _D),
    ("num_years_antig", _I), ("origin_up", _S), ("pow_max", _D),
]

CHURN_COLUMNS = [("id", _S), ("churn", _I)]

PRICE_COLUMNS = [
    ("id", _S), ("price_date", _S),
    ("price_p1_var", _D), ("price_p2_var", _D), ("price_p3_var", _D),
    ("price_p1_fix", _D), ("price_p2_fix", _D), ("price_p3_fix", _D),
]


def struct(columns) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns])


CUSTOMER_SCHEMA = struct(CUSTOMER_COLUMNS)
CHURN_SCHEMA = struct(CHURN_COLUMNS)
PRICE_SCHEMA = struct(PRICE_COLUMNS)

# Fixed column groups used by the reference analysis (values that must match).
PRICE_MEASURES = ["price_p1_var", "price_p2_var", "price_p3_var",
                  "price_p1_fix", "price_p2_fix", "price_p3_fix"]
PRICE_FIX = ["price_p1_fix", "price_p2_fix", "price_p3_fix"]
SPARSE_CUSTOMER_COLUMNS = ["campaign_disc_ele", "date_first_activ", "forecast_base_bill_ele",
                           "forecast_base_bill_year", "forecast_bill_12m", "forecast_cons"]
LOG_COLUMNS = ["cons_12m", "cons_gas_12m", "cons_last_month", "forecast_cons_12m",
               "forecast_cons_year", "forecast_meter_rent_12m", "imp_cons"]
CORRELATED_DROP = ["num_years_antig", "forecast_cons_year"]
OUTLIER_COLUMNS = ["cons_12m", "cons_gas_12m", "cons_last_month", "forecast_cons_12m",
                   "forecast_discount_energy", "forecast_meter_rent_12m",
                   "forecast_price_energy_p1", "forecast_price_energy_p2",
                   "forecast_price_pow_p1", "imp_cons", "margin_gross_pow_ele",
                   "margin_net_pow_ele", "net_margin", "pow_max", "months_activ",
                   "months_end", "months_modif_prod", "months_renewal"]
