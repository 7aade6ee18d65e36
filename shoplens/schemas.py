"""Declared schemas (DDL strings) of the data model; no inference on hot paths."""

PRODUCT = ("asin string, title string, imgUrl string, productURL string, stars double, "
           "reviews int, price double, listPrice double, category_id long, "
           "isBestSeller boolean, boughtInLastMonth int")
PRODUCT_TEXT = ("asin string, title string, imgUrl string, productURL string, stars string, "
                "reviews string, price string, listPrice string, category_id string, "
                "isBestSeller string, boughtInLastMonth string")
CATEGORY = "id long, category_name string"
RATING = "user_id long, asin string, rating float, timestamp timestamp_ntz"
REVIEW = ("event_id string, event_type string, dataset_source string, row_index long, "
          "timestamp timestamp_ntz, processing_time timestamp_ntz, user_id string, "
          "product_id string, rating string, review_text string, helpful string, title string, "
          "metadata map<string,string>")
ACTION = ("event_id string, user_id string, product_id string, action string, "
          "timestamp timestamp_ntz, source string, original_rating double, confidence double")
API_EVENT = "user_id long, action string, product_id string, timestamp string"
JSON_PRODUCT = ("asin string, title string, category string, price double, stars double, "
                "reviews int, brand string, description string, timestamp string")
JSON_RATING = "user_id int, asin string, rating double, timestamp string"
ML_CONFIG = ("als_max_iter int, als_reg_param double, recommendation_limit int, "
             "similarity_threshold double")
