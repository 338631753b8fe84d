"""Column layouts of the tables and messages the library reads and writes.

Layouts are DDL strings: readers and ``from_json`` take them as they are.
"""

RAW_BAR = (
    "ticker STRING, volume BIGINT, open DOUBLE, close DOUBLE, high DOUBLE, low DOUBLE, "
    "window_start BIGINT, transactions BIGINT"
)
RAW_BAR_COLUMNS = ["ticker", "volume", "open", "close", "high", "low", "window_start", "transactions"]

CLEAN_BAR = (
    "window_start_et TIMESTAMP_NTZ, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, "
    "volume BIGINT, transactions BIGINT, year INT, ticker STRING"
)
CLEAN_BAR_COLUMNS = [
    "ticker", "window_start_et", "open", "high", "low", "close", "volume", "transactions", "year",
]

SPLIT = "id STRING, execution_date DATE, split_from DOUBLE, split_to DOUBLE, ticker STRING"
SPLIT_EXPORT_COLUMNS = ["id", "execution_date", "split_from", "split_to", "ticker"]

DIVIDEND = (
    "id STRING, cash_amount DOUBLE, currency STRING, declaration_date DATE, dividend_type STRING, "
    "ex_dividend_date DATE, frequency INT, pay_date DATE, record_date DATE, ticker STRING"
)

AGGREGATE_BAR = (
    "ticker STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, vwap DOUBLE, "
    "timestamp BIGINT, transactions BIGINT, otc BOOLEAN"
)

DAILY_OPEN_CLOSE = (
    "symbol STRING, from DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, "
    "pre_market DOUBLE, after_hours DOUBLE, otc BOOLEAN"
)

TRADE = (
    "conditions ARRAY<INT>, correction INT, exchange INT, id STRING, participant_timestamp BIGINT, "
    "price DOUBLE, sequence_number BIGINT, sip_timestamp BIGINT, size DOUBLE, tape INT, trf_id INT, "
    "trf_timestamp BIGINT, ticker STRING"
)

QUOTE = (
    "ask_exchange INT, ask_price DOUBLE, ask_size DOUBLE, bid_exchange INT, bid_price DOUBLE, "
    "bid_size DOUBLE, conditions ARRAY<INT>, indicators ARRAY<INT>, participant_timestamp BIGINT, "
    "sequence_number BIGINT, sip_timestamp BIGINT, tape INT, trf_timestamp BIGINT, ticker STRING"
)

BOOK_LEVELS = "ARRAY<STRUCT<price: DOUBLE, exchange_shares: MAP<STRING, DOUBLE>>>"
ORDER_BOOK = (
    f"ticker STRING, bids {BOOK_LEVELS}, asks {BOOK_LEVELS}, bid_count DOUBLE, ask_count DOUBLE, "
    "spread DOUBLE, updated BIGINT"
)

NEWS = (
    "amp_url STRING, article_url STRING, author STRING, description STRING, id STRING, "
    "image_url STRING, insights ARRAY<STRUCT<sentiment: STRING, sentiment_reasoning: STRING, "
    "ticker: STRING>>, keywords ARRAY<STRING>, published_utc STRING, publisher STRUCT<"
    "favicon_url: STRING, homepage_url: STRING, logo_url: STRING, name: STRING>, "
    "tickers ARRAY<STRING>, title STRING"
)

DATA_POINT = (
    "STRUCT<label: STRING, order: INT, unit: STRING, value: DOUBLE, derived_from: ARRAY<STRING>, "
    "formula: STRING, source: MAP<STRING, STRING>, xpath: STRING>"
)
STATEMENTS = f"MAP<STRING, MAP<STRING, {DATA_POINT}>>"
FINANCIALS = (
    f"cik STRING, company_name STRING, end_date DATE, filing_date DATE, financials {STATEMENTS}, "
    "fiscal_period STRING, fiscal_year STRING, source_filing_file_url STRING, "
    "source_filing_url STRING, start_date DATE"
)

TICKER = (
    "active BOOLEAN, cik STRING, composite_figi STRING, currency_name STRING, currency_symbol STRING, "
    "base_currency_symbol STRING, base_currency_name STRING, delisted_utc STRING, "
    "last_updated_utc STRING, locale STRING, market STRING, name STRING, primary_exchange STRING, "
    "share_class_figi STRING, ticker STRING, type STRING, source_feed STRING"
)

EXCHANGE = (
    "acronym STRING, asset_class STRING, id INT, locale STRING, mic STRING, name STRING, "
    "operating_mic STRING, participant_id STRING, type STRING, url STRING"
)

UPDATE_RULE = "STRUCT<updates_high_low: BOOLEAN, updates_open_close: BOOLEAN, updates_volume: BOOLEAN>"
CONDITION = (
    "abbreviation STRING, asset_class STRING, data_types ARRAY<STRING>, description STRING, "
    "exchange INT, id INT, legacy BOOLEAN, name STRING, sip_mapping MAP<STRING, STRING>, type STRING, "
    f"update_rules STRUCT<consolidated: {UPDATE_RULE}, market_center: {UPDATE_RULE}>"
)

OPTIONS_CONTRACT = (
    "additional_underlyings ARRAY<STRUCT<amount: DOUBLE, type: STRING, underlying: STRING>>, "
    "cfi STRING, contract_type STRING, correction STRING, exercise_style STRING, "
    "expiration_date DATE, primary_exchange STRING, shares_per_contract DOUBLE, "
    "strike_price DOUBLE, ticker STRING, underlying_ticker STRING"
)

IPO = (
    "announced_date DATE, currency_code STRING, final_issue_price DOUBLE, highest_offer_price DOUBLE, "
    "ipo_status STRING, isin STRING, issuer_name STRING, last_updated STRING, listing_date DATE, "
    "lot_size BIGINT, lowest_offer_price DOUBLE, max_shares_offered BIGINT, "
    "min_shares_offered BIGINT, primary_exchange STRING, security_description STRING, "
    "security_type STRING, shares_outstanding BIGINT, ticker STRING, total_offer_size DOUBLE, "
    "us_code STRING"
)

HOLIDAY = "close STRING, date DATE, exchange STRING, name STRING, open STRING, status STRING"

# Named datasets of landed reference data.
DATASETS = {
    "splits": SPLIT,
    "dividends": DIVIDEND,
    "tickers": TICKER,
    "news": NEWS,
    "options_contracts": OPTIONS_CONTRACT,
    "financials": FINANCIALS,
    "ipos": IPO,
    "exchanges": EXCHANGE,
    "conditions": CONDITION,
    "holidays": HOLIDAY,
    "trades": TRADE,
    "quotes": QUOTE,
    "aggregates": AGGREGATE_BAR,
    "order_books": ORDER_BOOK,
    "daily_open_close": DAILY_OPEN_CLOSE,
}

# Fixed values of the event feed: message tag -> (kind, {short JSON key: (column, type)}).
_EQUITY_BAR = {
    "sym": ("symbol", "STRING"), "v": ("volume", "DOUBLE"), "av": ("accumulated_volume", "DOUBLE"),
    "op": ("official_open_price", "DOUBLE"), "vw": ("vwap", "DOUBLE"), "o": ("open", "DOUBLE"),
    "c": ("close", "DOUBLE"), "h": ("high", "DOUBLE"), "l": ("low", "DOUBLE"),
    "a": ("aggregate_vwap", "DOUBLE"), "z": ("average_size", "DOUBLE"),
    "s": ("start_timestamp", "BIGINT"), "e": ("end_timestamp", "BIGINT"), "otc": ("otc", "BOOLEAN"),
}
_CURRENCY_BAR = {
    "pair": ("pair", "STRING"), "o": ("open", "DOUBLE"), "c": ("close", "DOUBLE"),
    "h": ("high", "DOUBLE"), "l": ("low", "DOUBLE"), "v": ("volume", "DOUBLE"),
    "vw": ("vwap", "DOUBLE"), "s": ("start_timestamp", "BIGINT"), "e": ("end_timestamp", "BIGINT"),
    "z": ("avg_trade_size", "DOUBLE"),
}
_EQUITY_TRADE = {
    "sym": ("symbol", "STRING"), "x": ("exchange", "INT"), "i": ("id", "STRING"),
    "z": ("tape", "INT"), "p": ("price", "DOUBLE"), "s": ("size", "BIGINT"),
    "c": ("conditions", "ARRAY<INT>"), "t": ("timestamp", "BIGINT"),
    "q": ("sequence_number", "BIGINT"), "trfi": ("trf_id", "INT"), "trft": ("trf_timestamp", "BIGINT"),
}
_CRYPTO_TRADE = {
    "pair": ("pair", "STRING"), "x": ("exchange", "INT"), "i": ("id", "STRING"),
    "p": ("price", "DOUBLE"), "s": ("size", "DOUBLE"), "c": ("conditions", "ARRAY<INT>"),
    "t": ("timestamp", "BIGINT"), "r": ("received_timestamp", "BIGINT"),
}
_EQUITY_QUOTE = {
    "sym": ("symbol", "STRING"), "bx": ("bid_exchange_id", "INT"), "bp": ("bid_price", "DOUBLE"),
    "bs": ("bid_size", "BIGINT"), "ax": ("ask_exchange_id", "INT"), "ap": ("ask_price", "DOUBLE"),
    "as": ("ask_size", "BIGINT"), "c": ("condition", "INT"), "i": ("indicators", "ARRAY<INT>"),
    "t": ("timestamp", "BIGINT"), "z": ("tape", "INT"), "q": ("sequence_number", "BIGINT"),
    "trfi": ("trf_id", "INT"), "trft": ("trf_timestamp", "BIGINT"),
}
_FOREX_QUOTE = {
    "p": ("pair", "STRING"), "x": ("exchange_id", "INT"), "a": ("ask_price", "DOUBLE"),
    "b": ("bid_price", "DOUBLE"), "t": ("timestamp", "BIGINT"),
}
_CRYPTO_QUOTE = {
    "pair": ("pair", "STRING"), "bp": ("bid_price", "DOUBLE"), "bs": ("bid_size", "DOUBLE"),
    "ap": ("ask_price", "DOUBLE"), "as": ("ask_size", "DOUBLE"), "t": ("timestamp", "BIGINT"),
    "x": ("exchange_id", "INT"), "r": ("received_timestamp", "BIGINT"),
}
_IMBALANCE = {
    "T": ("symbol", "STRING"), "t": ("time_stamp", "BIGINT"), "at": ("auction_time", "BIGINT"),
    "a": ("auction_type", "STRING"), "i": ("symbol_sequence", "BIGINT"), "x": ("exchange_id", "INT"),
    "o": ("imbalance_quantity", "BIGINT"), "p": ("paired_quantity", "BIGINT"),
    "b": ("book_clearing_price", "DOUBLE"),
}
_LIMIT_BAND = {
    "T": ("symbol", "STRING"), "h": ("high_price", "DOUBLE"), "l": ("low_price", "DOUBLE"),
    "i": ("indicators", "ARRAY<INT>"), "z": ("tape", "INT"), "t": ("timestamp", "BIGINT"),
    "q": ("sequence_number", "BIGINT"),
}
_CRYPTO_BOOK = {
    "pair": ("pair", "STRING"), "b": ("bid_prices", "ARRAY<ARRAY<DOUBLE>>"),
    "a": ("ask_prices", "ARRAY<ARRAY<DOUBLE>>"), "t": ("timestamp", "BIGINT"),
    "x": ("exchange_id", "INT"), "r": ("received_timestamp", "BIGINT"),
}
_INDEX_VALUE = {"val": ("value", "DOUBLE"), "T": ("ticker", "STRING"), "t": ("timestamp", "BIGINT")}
_DISPLAY_VALUE = {"val": ("value", "DOUBLE"), "sym": ("symbol", "STRING"), "t": ("timestamp", "BIGINT")}
_FAIR_VALUE = {"fmv": ("fmv", "DOUBLE"), "sym": ("ticker", "STRING"), "t": ("timestamp", "BIGINT")}

EVENT_TYPES = {
    "A": ("equity_bar", _EQUITY_BAR),
    "AM": ("equity_bar", _EQUITY_BAR),
    "XA": ("currency_bar", _CURRENCY_BAR),
    "XAS": ("currency_bar", _CURRENCY_BAR),
    "CA": ("currency_bar", _CURRENCY_BAR),
    "CAS": ("currency_bar", _CURRENCY_BAR),
    "T": ("equity_trade", _EQUITY_TRADE),
    "XT": ("crypto_trade", _CRYPTO_TRADE),
    "Q": ("equity_quote", _EQUITY_QUOTE),
    "C": ("forex_quote", _FOREX_QUOTE),
    "XQ": ("crypto_quote", _CRYPTO_QUOTE),
    "NOI": ("imbalance", _IMBALANCE),
    "LULD": ("limit_band", _LIMIT_BAND),
    "XL2": ("crypto_book", _CRYPTO_BOOK),
    "V": ("index_value", _INDEX_VALUE),
    "LV": ("display_value", _DISPLAY_VALUE),
    "FMV": ("fair_value", _FAIR_VALUE),
}
STATUS_EVENT = "status"

# Landed aggregate pages use these short keys.
AGGREGATE_KEYS = {
    "T": ("ticker", "STRING"), "o": ("open", "DOUBLE"), "h": ("high", "DOUBLE"), "l": ("low", "DOUBLE"),
    "c": ("close", "DOUBLE"), "v": ("volume", "DOUBLE"), "vw": ("vwap", "DOUBLE"),
    "t": ("timestamp", "BIGINT"), "n": ("transactions", "BIGINT"), "otc": ("otc", "BOOLEAN"),
}
