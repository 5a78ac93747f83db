"""Constants of the trading rules. Fixed values."""

CAPITAL = 1_350_000.0
MAX_POSITION_SHARE, MAX_POSITIONS, MAX_MARGIN_SHARE = 0.07, 8, 0.60
OPTION_STOP, THETA_STOP, VIX_SPIKE = 0.35, 0.30, 0.25
SLOTS = {2: 3, 5: 2, 10: 2, 15: 1}
WAIT_DAYS = {2: 0, 5: 2, 10: 3, 15: 4}
CONFIDENT, UNSURE, CONFIDENCE_DROP = 0.70, 0.50, 0.20
BANDIT_TRADES, META_TRADES, META_THRESHOLD = 200, 150, 0.58
IV_MULTIPLIER, RISK_FREE = 1.10, 0.065
REGIMES = ["H_BEAR", "L_BEAR", "SIDEWAYS", "L_BULL", "H_BULL"]  # by ascending mean return
BULL = ["H_BULL", "L_BULL"]
STRIKE_STEPS = {"NIFTY": 50, "BANKNIFTY": 100, "FINNIFTY": 50, "MIDCPNIFTY": 25, "GOLD": 100, "SILVER": 100, "CRUDEOIL": 50, "COPPER": 5, "USDINR": 0.25, "EURUSD": 0.001}
USD_PROXY = {"GOLD": "GOLD_USD", "SILVER": "SILVER_USD", "CRUDEOIL": "CRUDE_USD", "COPPER": "COPPER_USD"}
SLIPPAGE_OPTIONS = {2: 0.05, 5: 0.06, 10: 0.08, 15: 0.10}
SLIPPAGE_FUTURES = {2: 0.0015, 5: 0.0020, 10: 0.0025, 15: 0.0030}
#: edge: (holding period, regime, direction, prior win rate)
EDGES = {
    "SEED-001": (5, "SIDEWAYS", "BOTH", 0.58),
    "SEED-002": (2, "SIDEWAYS", "LONG", 0.60),
    "SEED-003": (5, "ALL", "LONG", 0.67),
    "SEED-004": (10, "H_BULL", "LONG", 0.56),
    "SEED-005": (5, "SIDEWAYS", "BOTH", 0.56),
    "SEED-006": (10, "SIDEWAYS", "BOTH", 0.57),
}
