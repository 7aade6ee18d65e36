"""Fixed values that must equal the reference behaviour for identical results.

They are kept together, in their natural order, as plain text.
"""

# --- fixed values: review sentiment word lists -------------------------------
POSITIVE_WORDS = [
    "excellent", "amazing", "great", "good", "love", "perfect", "best", "awesome",
    "fantastic", "wonderful", "outstanding", "superb", "brilliant", "impressive",
]
NEGATIVE_WORDS = [
    "terrible", "awful", "bad", "hate", "worst", "horrible", "disappointing",
    "useless", "poor", "cheap", "broken", "defective", "waste",
]

# --- fixed values: interaction action weights (unknown action -> 1.0) --------
ACTION_WEIGHTS = {
    "view": 1.0,
    "click": 2.0,
    "cart_add": 3.0,
    "purchase": 5.0,
    "like": 4.0,
    "share": 3.5,
}
DEFAULT_ACTION_WEIGHT = 1.0

# --- fixed values: trigger lists ----------------------------------------------
STREAM_TRIGGER_ACTIONS = ["purchase", "like", "cart_add"]
API_TRIGGER_ACTIONS = ["view", "purchase", "like"]

# --- fixed values: canonical review columns and their aliases (first hit wins)
CANONICAL_COLUMNS = {
    "user_id": ["user_id", "userId", "reviewerID", "reviewer_id", "customer_id"],
    "product_id": ["product_id", "productId", "asin", "ASIN", "item_id", "product"],
    "rating": ["rating", "overall", "score", "stars", "review_score"],
    "review_text": ["review_text", "reviewText", "summary", "text", "review", "comment"],
    "timestamp": ["timestamp", "unixReviewTime", "reviewTime", "date", "review_date"],
    "helpful": ["helpful", "helpfulness", "helpful_votes"],
    "title": ["title", "product_title", "name", "item_name"],
}

# --- fixed values: encodings tried in turn when reading text files -----------
ENCODINGS = ["utf-8", "latin-1", "cp1252", "iso-8859-1"]

# --- fixed values: neighbour recommender ---------------------------------------
JACCARD_THRESHOLD = 0.1      # a neighbour needs similarity strictly above this
TOP_NEIGHBOURS = 5
TOP_RECOMMENDATIONS = 5
DEFAULT_PREDICTED_RATING = 4.0
PREFERENCE_MAX_LEN = 50      # metadata values shorter than this count as preferences

# --- fixed values: count triggers of the event stream -----------------------
REVIEWS_PER_RECOMMENDATION = 10
EVENTS_PER_REPORT = 25

# --- fixed values: ALS training --------------------------------------------------
ALS_RANK = 10
ALS_MAX_ITER = 5
ALS_REG_PARAM = 0.1
ALS_SEED = 42
ALS_TRAIN_FRACTION = 0.8

# --- fixed values: API argument bounds and periods ---------------------------
LIMIT_BOUNDS = {"recommendations": (1, 50), "similar": (1, 30),
                "trending": (1, 100), "category": (1, 50)}
PERIOD_DAYS = {"day": 1, "week": 7, "month": 30}

# --- fixed values: live-metric alert ------------------------------------------
LATENCY_ALERT_THRESHOLD = 180.0

# --- our own value: window metrics warn above this average order value ---------
ORDER_VALUE_ALERT_THRESHOLD = 180.0

# --- fixed values: actions counted as columns, and the columns' names -----------
PIVOT_ACTIONS = ["view", "click", "purchase", "like", "share", "cart_add"]
PIVOT_NAMES = {"view": "views", "click": "clicks", "purchase": "purchases", "like": "likes",
               "share": "shares", "cart_add": "cart_adds"}

# --- fixed values: labels of processed API events -------------------------------
PRIORITY_VIEW = "high"
PRIORITY_PURCHASE = "critical"
PRIORITY_SOCIAL = "medium"
TRIGGERS_PURCHASE = ["recommendation_update", "user_model_retrain"]
TRIGGERS_SOCIAL = ["preference_update"]
IMPACT_PURCHASE = "high"
IMPACT_SOCIAL = "medium"

# --- fixed values: labels and id formats of the emitted records -------------
REVIEW_EVENT_TYPE = "amazon_review"
REVIEW_EVENT_ID_PREFIX = "csv_"
ANALYTICS_DATA_SOURCE = "csv_amazon_dataset"
RECOMMENDATION_METHOD = "csv_collaborative_filtering"
DERIVED_INTERACTION_SOURCE = "csv_derived"
REVIEW_PROCESSING_PREFIX = "csv_proc_"
INTERACTION_PROCESSING_PREFIX = "int_proc_"
INTERACTION_ID_FORMAT = "interaction_%06d"
