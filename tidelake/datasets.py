"""The market datasets, declared plainly.

Fixed values: names, fields, types, units, partitions, keys, and the sizes of files and row groups that the lake's files have.
"""

MARKET = {
    "version": 1,
    "datasets": {
        "bars_daily": {
            "root": "canonical/bars_daily",
            "partitions": ["year"],
            "primary_key": ["ts_code", "trade_date"],
            "sorted_by": ["ts_code", "trade_date"],
            "writer": {"row_group_rows": 8192, "target_file_rows": 2000000},
            "fields": [
                {"name": "ts_code", "type": "string"},
                {"name": "trade_date", "type": "date"},
                {"name": "open", "type": "float64"},
                {"name": "high", "type": "float64"},
                {"name": "low", "type": "float64"},
                {"name": "close", "type": "float64"},
                {"name": "pre_close", "type": "float64"},
                {"name": "change", "type": "float64"},
                {"name": "pct_chg", "type": "float64", "unit": "percent"},
                {"name": "vol", "type": "float64", "unit": "hand"},
                {"name": "amount", "type": "float64", "unit": "k_cny"},
                {"name": "turnover_rate", "type": "float64", "unit": "percent"},
                {"name": "turnover_rate_f", "type": "float64", "unit": "percent"},
                {"name": "volume_ratio", "type": "float64"},
                {"name": "pe", "type": "float64"},
                {"name": "pe_ttm", "type": "float64"},
                {"name": "pb", "type": "float64"},
                {"name": "ps", "type": "float64"},
                {"name": "ps_ttm", "type": "float64"},
                {"name": "dv_ratio", "type": "float64"},
                {"name": "dv_ttm", "type": "float64"},
                {"name": "total_share", "type": "float64", "unit": "10k_share"},
                {"name": "float_share", "type": "float64", "unit": "10k_share"},
                {"name": "free_share", "type": "float64", "unit": "10k_share"},
                {"name": "total_mv", "type": "float64", "unit": "10k_cny"},
                {"name": "circ_mv", "type": "float64", "unit": "10k_cny"},
            ],
        },
        "bars_1m": {
            "root": "canonical/bars_1m",
            "partitions": ["market", "year", "month"],
            "primary_key": ["ts_code", "trade_time"],
            "sorted_by": ["ts_code", "trade_time"],
            "writer": {"row_group_rows": 8192, "target_file_rows": 12000000},
            "fields": [
                {"name": "ts_code", "type": "string"},
                {"name": "trade_time", "type": "timestamp"},
                {"name": "open", "type": "float64"},
                {"name": "high", "type": "float64"},
                {"name": "low", "type": "float64"},
                {"name": "close", "type": "float64"},
                {"name": "vol", "type": "float64", "unit": "hand"},
                {"name": "amount", "type": "float64", "unit": "k_cny"},
            ],
        },
        "daily_cross": {
            "root": "canonical/daily_cross",
            "partitions": ["year"],
            "primary_key": ["ts_code", "trade_date"],
            "sorted_by": ["trade_date", "ts_code"],
            "writer": {"row_group_rows": 8192, "target_file_rows": 4000000},
            "fields": [
                {"name": "ts_code", "type": "string"},
                {"name": "trade_date", "type": "date"},
                {"name": "close", "type": "float64"},
                {"name": "pre_close", "type": "float64"},
                {"name": "pct_chg", "type": "float64", "unit": "percent"},
                {"name": "vol", "type": "float64", "unit": "hand"},
                {"name": "amount", "type": "float64", "unit": "k_cny"},
                {"name": "turnover_rate", "type": "float64", "unit": "percent"},
                {"name": "pe", "type": "float64"},
                {"name": "pe_ttm", "type": "float64"},
                {"name": "pb", "type": "float64"},
                {"name": "ps", "type": "float64"},
                {"name": "ps_ttm", "type": "float64"},
                {"name": "dv_ttm", "type": "float64"},
                {"name": "total_share", "type": "float64", "unit": "10k_share"},
                {"name": "float_share", "type": "float64", "unit": "10k_share"},
                {"name": "free_share", "type": "float64", "unit": "10k_share"},
                {"name": "total_mv", "type": "float64", "unit": "10k_cny"},
                {"name": "circ_mv", "type": "float64", "unit": "10k_cny"},
            ],
        },
        "adj_factor": {
            "root": "canonical/adj_factor",
            "partitions": ["factor_type", "year"],
            "primary_key": ["ts_code", "trade_date"],
            "sorted_by": ["ts_code", "trade_date"],
            "writer": {"row_group_rows": 8192, "target_file_rows": 4000000},
            "fields": [
                {"name": "ts_code", "type": "string"},
                {"name": "trade_date", "type": "date"},
                {"name": "adj_factor", "type": "float64"},
            ],
        },
        "corporate_actions": {
            "root": "canonical/corporate_actions",
            "partitions": ["year"],
            "primary_key": ["ts_code", "ex_date"],
            "sorted_by": ["ts_code", "ex_date"],
            "writer": {"row_group_rows": 8192, "target_file_rows": 4000000},
            "fields": [
                {"name": "ts_code", "type": "string"},
                {"name": "ex_date", "type": "date"},
                {"name": "allotted_ps", "type": "float64"},
                {"name": "rationed_ps", "type": "float64"},
                {"name": "rationed_px", "type": "float64"},
                {"name": "bonus_ps", "type": "float64"},
                {"name": "exer_forward_a", "type": "float64"},
                {"name": "exer_forward_b", "type": "float64"},
                {"name": "exer_backward_a", "type": "float64"},
                {"name": "exer_backward_b", "type": "float64"},
            ],
        },
        "stock_basic": {
            "root": "canonical/stock_basic",
            "partitions": [],
            "primary_key": ["ts_code"],
            "sorted_by": ["ts_code"],
            "writer": {"row_group_rows": 8192, "target_file_rows": 2000000},
            "fields": [
                {"name": "ts_code", "type": "string"},
                {"name": "symbol", "type": "string"},
                {"name": "name", "type": "string"},
                {"name": "area", "type": "string"},
                {"name": "industry", "type": "string"},
                {"name": "fullname", "type": "string"},
                {"name": "enname", "type": "string"},
                {"name": "cnspell", "type": "string"},
                {"name": "market", "type": "string"},
                {"name": "exchange", "type": "string"},
                {"name": "curr_type", "type": "string"},
                {"name": "list_status", "type": "string"},
                {"name": "list_date", "type": "date"},
                {"name": "delist_date", "type": "date"},
                {"name": "is_hs", "type": "string"},
                {"name": "act_name", "type": "string"},
                {"name": "act_ent_type", "type": "string"},
            ],
        },
        "trade_cal": {
            "root": "canonical/trade_cal",
            "partitions": [],
            "primary_key": ["exchange", "cal_date"],
            "sorted_by": ["cal_date"],
            "writer": {"row_group_rows": 8192, "target_file_rows": 4000000},
            "fields": [
                {"name": "exchange", "type": "string"},
                {"name": "cal_date", "type": "date"},
                {"name": "is_open", "type": "int64"},
                {"name": "pretrade_date", "type": "date"},
            ],
        },
        "stk_limit": {
            "root": "canonical/stk_limit",
            "partitions": ["year"],
            "primary_key": ["ts_code", "trade_date"],
            "sorted_by": ["ts_code", "trade_date"],
            "writer": {"row_group_rows": 8192, "target_file_rows": 4000000},
            "fields": [
                {"name": "ts_code", "type": "string"},
                {"name": "trade_date", "type": "date"},
                {"name": "pre_close", "type": "float64"},
                {"name": "up_limit", "type": "float64"},
                {"name": "down_limit", "type": "float64"},
            ],
        },
        "suspend_d": {
            "root": "canonical/suspend_d",
            "partitions": ["year"],
            "primary_key": ["ts_code", "trade_date"],
            "sorted_by": ["ts_code", "trade_date"],
            "writer": {"row_group_rows": 8192, "target_file_rows": 4000000},
            "fields": [
                {"name": "ts_code", "type": "string"},
                {"name": "trade_date", "type": "date"},
                {"name": "suspend_timing", "type": "string"},
                {"name": "suspend_type", "type": "string"},
            ],
        },
        "namechange": {
            "root": "canonical/namechange",
            "partitions": ["year"],
            "primary_key": ["ts_code", "start_date"],
            "sorted_by": ["ts_code", "start_date"],
            "writer": {"row_group_rows": 8192, "target_file_rows": 4000000},
            "fields": [
                {"name": "ts_code", "type": "string"},
                {"name": "name", "type": "string"},
                {"name": "start_date", "type": "date"},
                {"name": "end_date", "type": "date"},
                {"name": "ann_date", "type": "date"},
                {"name": "change_reason", "type": "string"},
            ],
        },
        "index_basic": {
            "root": "canonical/index_basic",
            "partitions": [],
            "primary_key": ["ts_code"],
            "sorted_by": ["ts_code"],
            "writer": {"row_group_rows": 8192, "target_file_rows": 2000000},
            "fields": [
                {"name": "ts_code", "type": "string"},
                {"name": "name", "type": "string"},
                {"name": "fullname", "type": "string"},
                {"name": "market", "type": "string"},
                {"name": "publisher", "type": "string"},
                {"name": "index_type", "type": "string"},
                {"name": "category", "type": "string"},
                {"name": "base_date", "type": "date"},
                {"name": "base_point", "type": "float64"},
                {"name": "list_date", "type": "date"},
            ],
        },
        "index_daily": {
            "root": "canonical/index_daily",
            "partitions": ["year"],
            "primary_key": ["ts_code", "trade_date"],
            "sorted_by": ["ts_code", "trade_date"],
            "writer": {"row_group_rows": 8192, "target_file_rows": 4000000},
            "fields": [
                {"name": "ts_code", "type": "string"},
                {"name": "trade_date", "type": "date"},
                {"name": "close", "type": "float64"},
                {"name": "open", "type": "float64"},
                {"name": "high", "type": "float64"},
                {"name": "low", "type": "float64"},
                {"name": "pre_close", "type": "float64"},
                {"name": "change", "type": "float64"},
                {"name": "pct_chg", "type": "float64", "unit": "percent"},
                {"name": "vol", "type": "float64", "unit": "hand"},
                {"name": "amount", "type": "float64", "unit": "k_cny"},
            ],
        },
    },
}
