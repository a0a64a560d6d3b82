"""Weights, category tables and bonuses of the recommendation domain."""

# Interaction weights by scheme; an unknown type weighs DEFAULT_WEIGHT.
WEIGHTS = {
    "pipeline": {"purchase": 5.0, "like": 3.0, "cart": 2.0, "view": 1.0},
    "engine": {"purchase": 5.0, "cart": 3.5, "like": 2.5, "review": 2.0, "view": 1.0},
    "embedding": {"purchase": 3.0, "cart": 1.5, "review": 1.2, "like": 1.0, "view": 0.5},
}
DEFAULT_WEIGHT = 1.0
POSITIVE = ("purchase", "like", "cart")
FEATURES = ("master_category", "sub_category", "article_type", "base_colour", "usage")
ALL_GENDERS = ("Boys", "Girls", "Men", "Unisex", "Women")
# What re-scoring adds for usage, gender and preferences.
USAGE_BONUS, GENDER_BONUS, UNISEX_BONUS, OFF_GENDER, ARTICLE_PREF, USAGE_PREF = 0.08, 0.06, 0.03, -0.01, 0.05, 0.04
SLOTS = ("accessories", "bottomwear", "footwear", "topwear")

# Derivation of the product role from the provided part table: p_type -> (article, sub, master).
ARTICLES = {
    "STANDARD": ("Tshirts", "Topwear", "Apparel"),
    "ECONOMY": ("Jeans", "Bottomwear", "Apparel"),
    "MEDIUM": ("Casual Shoes", "Shoes", "Footwear"),
    "PROMO": ("Watches", "Watches", "Accessories"),
    "LARGE": ("Dresses", "Dress", "Apparel"),
    "SMALL": ("Sandals", "Sandal", "Footwear"),
}
CATEGORY_KEYS = {"Topwear": "topwear", "Bottomwear": "bottomwear", "Shoes": "footwear", "Sandal": "footwear", "Flip Flops": "footwear", "Watches": "accessories", "Bags": "accessories", "Belts": "accessories", "Headwear": "accessories", "Dress": "dress", "Innerwear": "innerwear"}
CATEGORY_TAGS = {"Tshirts": "tops", "Jeans": "bottoms", "Casual Shoes": "shoes", "Sandals": "shoes", "Watches": "accessories", "Dresses": "dresses"}

# Names shown for article types (by lower-case name).
LABELS = {
    "shirts": "shirts", "tshirts": "t-shirts", "tops": "tops", "jackets": "jackets", "sweaters": "sweaters", "sweatshirts": "sweatshirts", "tunics": "tunics", "topwear": "tops",
    "jeans": "jeans", "trousers": "trousers", "shorts": "shorts", "skirts": "skirts", "capris": "capris", "track pants": "track pants", "bottomwear": "bottoms",
    "dresses": "dresses", "dress": "dress",
    "casual shoes": "casual shoes", "formal shoes": "formal shoes", "sports shoes": "sports shoes", "sneakers": "sneakers", "heels": "heels", "flats": "flats", "sandals": "sandals", "flip flops": "flip flops", "shoes": "shoes",
    "watches": "watches", "belts": "belts", "bags": "bags", "backpacks": "backpacks", "handbags": "handbags", "caps": "caps", "accessories": "accessories",
}

# Article types of each sub-category, and those that are left out for men and for people of no known gender.
ARTICLE_TYPES = {
    "Bags": ["Backpacks", "Handbags"],
    "Belts": ["Belts"],
    "Headwear": ["Caps"],
    "Watches": ["Watches"],
    "Bottomwear": ["Capris", "Jeans", "Shorts", "Skirts", "Track Pants", "Tracksuits", "Trousers"],
    "Dress": ["Dresses"],
    "Innerwear": ["Bra"],
    "Topwear": ["Jackets", "Shirts", "Sweaters", "Sweatshirts", "Tops", "Tshirts", "Tunics"],
    "Flip Flops": ["Flip Flops"],
    "Sandal": ["Sandals", "Sports Sandals"],
    "Shoes": ["Casual Shoes", "Flats", "Formal Shoes", "Heels", "Sandals", "Sports Shoes"],
}
NOT_FOR_MEN = ["Skirts", "Dresses", "Bra", "Heels", "Flats"]
NOT_FOR_OTHERS = ["Skirts", "Dresses", "Bra", "Heels"]

# What completes an outfit that begins with a product of a category.
COMPLETION = {
    "tops": ["bottoms", "shoes", "accessories"],
    "bottoms": ["tops", "shoes", "accessories"],
    "dresses": ["shoes", "accessories"],
    "shoes": ["tops", "bottoms", "accessories"],
    "accessories": ["tops", "bottoms"],
}

# What a recommendation is explained with.
NO_REASON = "Suggestions based on your interaction history"
REASONS = {
    "gender": "Suitable for your {} gender",
    "unisex": "Suitable for all genders",
    "young": "Suitable for your young age",
    "middle": "Suitable for your middle age",
    "old": "Suitable for your age",
    "colour": "Similar to products you've viewed: {}",
    "article": "You have shown interest in {}",
    "season": "Suitable for {} season",
    "none": "Recommended based on your preferences",
}

# What is said of an outfit.
OUTFIT_REASONS = {"items": "Perfect combination with ", "none": "Complete outfit for "}

# Sub-categories of the two slots that a master category fills as well.
ACCESSORY_SUBS = ("bags", "belts", "headwear", "watches")
FOOTWEAR_SUBS = ("shoes", "sandal", "flip flops")

# Weights of a user's stated styles and of the current product in a style profile.
PREFERENCE_WEIGHT, CURRENT_WEIGHT = 1.5, 0.5
