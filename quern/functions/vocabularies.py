"""Dictionaries of the classifiers and converters: dimension tables whose values results depend on."""

from __future__ import annotations

# Item categories, in the order in which they are tried.
PRIORITY = {
    "Beverages": ("wine", "white wine", "red wine", "beer", "champagne"),
    "Baking Essentials": ("all-purpose flour", "bread flour", "cake flour", "self-rising flour", "baking powder", "baking soda", "vanilla extract"),
}
CATEGORIES = {
    "Meat": ("beef", "pork", "lamb", "veal", "venison", "bacon", "ham", "sausage"),
    "Poultry": ("chicken", "turkey", "duck", "goose", "quail"),
    "Seafood": ("fish", "salmon", "tuna", "cod", "halibut", "shrimp", "crab", "lobster", "scallops", "mussels", "clams", "oysters"),
    "Dairy": (
        "milk", "buttermilk", "heavy cream", "light cream", "sour cream", "half and half", "cheese", "cheddar", "mozzarella", "parmesan", "swiss", "goat cheese", "cream cheese",
        "ricotta", "feta", "butter", "clarified butter", "ghee", "margarine", "yogurt", "greek yogurt", "plain yogurt",
    ),
    "Vegetables": (
        "onion", "garlic", "shallot", "leek", "scallion", "green onion", "carrot", "potato", "sweet potato", "beet", "turnip", "parsnip", "radish", "spinach", "kale", "lettuce",
        "arugula", "chard", "cabbage", "bok choy", "broccoli", "cauliflower", "brussels sprouts", "tomato", "bell pepper", "eggplant", "jalapeño", "serrano", "poblano", "zucchini",
        "yellow squash", "butternut squash", "acorn squash", "pumpkin", "mushroom", "shiitake", "portobello", "cremini", "button mushroom", "basil", "cilantro", "parsley", "mint",
        "dill", "chives", "tarragon",
    ),
}
PATTERNS = {"Pantry Staples": ("flour", "sugar", "salt", "oil"), "Herbs & Spices": ("herb", "spice", "seasoning")}
# End of fixed values.

# Words of cuisines.
CUISINES = {
    "Italian": ("pasta", "pizza", "risotto", "gnocchi", "lasagna", "spaghetti", "fettuccine", "parmesan", "mozzarella", "basil", "oregano", "marinara", "pesto", "carbonara", "bolognese", "alfredo", "tiramisu", "gelato", "prosciutto", "pancetta"),
    "Mexican": ("tacos", "burritos", "quesadillas", "enchiladas", "salsa", "guacamole", "cilantro", "lime", "jalapeño", "chipotle", "cumin", "chili powder", "tortilla", "beans", "avocado", "corn", "queso", "chorizo", "poblano"),
    "Asian": ("soy sauce", "ginger", "garlic", "sesame oil", "rice vinegar", "miso", "tofu", "noodles", "stir fry", "wok", "chopsticks", "green onions", "bok choy", "shiitake", "wasabi", "sriracha", "hoisin", "teriyaki"),
    "Chinese": ("soy sauce", "ginger", "garlic", "sesame oil", "rice wine", "cornstarch", "stir fry", "wok", "bok choy", "shiitake", "hoisin", "five spice", "szechuan", "kung pao", "sweet and sour", "lo mein", "fried rice"),
    "Indian": ("curry", "turmeric", "cumin", "coriander", "cardamom", "cinnamon", "garam masala", "basmati rice", "naan", "ghee", "yogurt", "lentils", "chickpeas", "tandoori", "biryani", "masala", "chai", "paneer"),
    "Mediterranean": ("olive oil", "olives", "feta", "lemon", "herbs", "tomatoes", "cucumber", "hummus", "tahini", "pita", "tzatziki", "oregano", "rosemary", "thyme", "capers", "sun-dried tomatoes", "pine nuts", "couscous"),
    "French": ("butter", "cream", "wine", "herbs", "shallots", "baguette", "cheese", "croissant", "brie", "camembert", "cognac", "champagne", "roux", "béarnaise", "hollandaise", "coq au vin", "bouillabaisse", "ratatouille"),
    "Thai": ("coconut milk", "fish sauce", "lime", "lemongrass", "galangal", "kaffir lime", "thai basil", "chili", "pad thai", "curry paste", "jasmine rice", "peanuts", "tamarind", "palm sugar", "tom yum", "green curry"),
    "Japanese": ("soy sauce", "miso", "sake", "mirin", "dashi", "nori", "wasabi", "ginger", "sushi", "sashimi", "tempura", "ramen", "udon", "soba", "teriyaki", "katsu", "edamame", "panko", "shiitake"),
    "Middle Eastern": ("tahini", "hummus", "pita", "falafel", "za'atar", "sumac", "pomegranate", "dates", "pistachios", "lamb", "yogurt", "mint", "parsley", "bulgur", "couscous", "harissa", "preserved lemons", "rose water"),
}
# End of fixed values.

# Words of meals.
MEALS = {
    "Breakfast": ("eggs", "bacon", "pancakes", "waffles", "toast", "cereal", "oatmeal", "yogurt", "granola", "muffins", "bagels", "coffee", "orange juice", "breakfast", "morning", "brunch", "omelet", "french toast", "hash browns"),
    "Lunch": ("sandwich", "salad", "soup", "wrap", "panini", "burger", "pizza slice", "lunch", "midday", "light meal", "quick", "office", "work", "deli"),
    "Dinner": ("roast", "steak", "chicken breast", "salmon", "pasta", "rice dish", "casserole", "main course", "dinner", "evening", "family meal", "hearty", "substantial", "protein", "sides"),
    "Appetizer": ("dip", "chips", "crackers", "cheese board", "bruschetta", "canapés", "hors d'oeuvres", "starter", "small plates", "finger food", "party", "appetizer", "before dinner", "snack"),
    "Dessert": ("cake", "cookies", "pie", "ice cream", "chocolate", "sweet", "sugar", "dessert", "after dinner", "treat", "baking", "frosting", "candy", "pudding", "mousse", "tart", "pastry"),
    "Snack": ("quick", "easy", "portable", "on-the-go", "between meals", "light", "nuts", "fruit", "crackers", "energy", "bite-sized", "snack"),
    "Side Dish": ("side", "accompaniment", "goes with", "serve alongside", "complement", "vegetables", "rice", "potatoes", "bread", "salad"),
}
# End of fixed values.

# Words of tags, by family.
TAGS = {
    "Cooking Methods": {
        "Baked": ("bake", "oven", "baking", "roast", "roasted"),
        "Grilled": ("grill", "grilled", "barbecue", "bbq", "charcoal"),
        "Fried": ("fry", "fried", "deep fry", "pan fry", "sauté"),
        "Slow Cooked": ("slow cooker", "crockpot", "braised", "stewed", "simmered"),
        "No Cook": ("no cook", "raw", "fresh", "uncooked", "cold"),
        "One Pot": ("one pot", "one pan", "skillet", "single pot"),
        "Pressure Cooker": ("instant pot", "pressure cooker", "pressure cook"),
    },
    "Occasion": {
        "Weeknight": ("weeknight", "quick dinner", "after work", "busy night"),
        "Weekend": ("weekend", "leisurely", "sunday", "brunch", "family time"),
        "Holiday": ("holiday", "christmas", "thanksgiving", "easter", "celebration"),
        "Party": ("party", "entertaining", "crowd", "potluck", "gathering"),
        "Date Night": ("romantic", "date night", "elegant", "special occasion"),
        "Kids": ("kid-friendly", "children", "family", "picky eaters"),
    },
    "Dietary": {
        "Healthy": ("healthy", "nutritious", "wholesome", "clean eating", "balanced"),
        "Comfort Food": ("comfort", "hearty", "warming", "cozy", "satisfying"),
        "Light": ("light", "fresh", "clean", "refreshing", "summer"),
        "Indulgent": ("rich", "decadent", "indulgent", "creamy", "buttery"),
    },
    "Season": {
        "Summer": ("summer", "fresh", "cold", "grilled", "salad", "berries"),
        "Fall": ("fall", "autumn", "pumpkin", "apple", "warming", "spiced"),
        "Winter": ("winter", "warming", "hearty", "stew", "soup", "comfort"),
        "Spring": ("spring", "fresh", "light", "green", "herbs", "asparagus"),
    },
}
# End of fixed values.

# Words of cooking methods, their weights (5 for others), names, and which of them use heat.
METHODS = {
    "bake": ("bake", "baking", "baked", "oven", "roast", "roasting", "roasted"),
    "fry": ("fry", "frying", "fried", "pan-fry", "deep-fry", "sauté", "sautéing", "sautéed"),
    "grill": ("grill", "grilling", "grilled", "barbecue", "bbq", "char", "charring"),
    "boil": ("boil", "boiling", "boiled", "simmer", "simmering", "poach", "poaching"),
    "steam": ("steam", "steaming", "steamed"),
    "braise": ("braise", "braising", "braised", "slow cook", "slow-cook"),
    "broil": ("broil", "broiling", "broiled"),
    "smoke": ("smoke", "smoking", "smoked"),
    "mix": ("mix", "mixing", "mixed", "combine", "combining", "stir", "stirring"),
    "chop": ("chop", "chopping", "chopped", "dice", "dicing", "mince", "mincing"),
    "blend": ("blend", "blending", "blended", "puree", "process"),
    "marinate": ("marinate", "marinating", "marinated"),
    "chill": ("chill", "chilling", "chilled", "refrigerate", "cool"),
    "freeze": ("freeze", "freezing", "frozen"),
}
METHOD_WEIGHTS = {"bake": 25, "braise": 30, "fry": 10, "grill": 15, "broil": 12, "boil": 15, "steam": 12, "smoke": 40, "mix": 2, "blend": 3, "chop": 5, "marinate": 15, "chill": 10, "freeze": 5}
METHOD_NAMES = {"bake": "Baking", "fry": "Frying", "grill": "Grilling", "boil": "Boiling", "steam": "Steaming", "braise": "Braising", "broil": "Broiling", "smoke": "Smoking", "mix": "Mixing", "chop": "Preparation", "blend": "Blending", "marinate": "Marinating", "chill": "Chilling", "freeze": "Freezing"}
HEAT = ("bake", "fry", "grill", "boil", "steam", "braise", "broil", "smoke")
# End of fixed values.

# Grams a millilitre, tried in this order.
DENSITIES = {
    "water": 1.0, "milk": 1.03, "whole milk": 1.03, "skim milk": 1.035, "heavy cream": 0.994, "cream": 0.994, "wine": 0.99, "white wine": 0.99, "red wine": 0.99, "beer": 1.005,
    "broth": 1.0, "stock": 1.0, "chicken stock": 1.0, "beef stock": 1.0, "vegetable stock": 1.0, "oil": 0.92, "olive oil": 0.915, "vegetable oil": 0.92, "coconut oil": 0.924,
    "butter": 0.911, "vinegar": 1.01, "soy sauce": 1.15, "fish sauce": 1.1, "worcestershire sauce": 1.12, "honey": 1.42, "maple syrup": 1.37, "corn syrup": 1.48, "molasses": 1.4,
    "flour": 0.593, "all-purpose flour": 0.593, "bread flour": 0.602, "cake flour": 0.514, "sugar": 0.845, "granulated sugar": 0.845, "brown sugar": 0.9, "powdered sugar": 0.56,
    "salt": 1.217, "baking powder": 0.9, "baking soda": 2.2, "almonds": 0.64, "walnuts": 0.52, "pecans": 0.41, "pine nuts": 0.68, "sesame seeds": 0.61, "rice": 0.75, "quinoa": 0.85,
    "oats": 0.41, "breadcrumbs": 0.43, "parmesan": 0.42, "parmesan cheese": 0.42, "cheddar": 0.45, "mozzarella": 0.48, "ricotta": 1.04, "onion": 0.64, "onions": 0.64, "garlic": 0.64,
    "celery": 0.64, "carrots": 0.64, "tomatoes": 0.95, "bell pepper": 0.52, "mushrooms": 0.35, "parsley": 0.64, "parsley leaves": 0.64, "sage": 0.64, "sage leaves": 0.64, "basil": 0.64,
    "basil leaves": 0.64, "cilantro": 0.64, "thyme": 0.64, "rosemary": 0.64, "chicken": 1.0, "beef": 1.0, "pork": 1.0, "fish": 1.0, "shrimp": 0.85, "beans": 0.77, "chickpeas": 0.82,
    "lentils": 0.85, "lemon juice": 1.02, "lime juice": 1.02, "orange juice": 1.05, "apple": 0.64, "berries": 0.65, "pasta": 0.67, "noodles": 0.67, "spaghetti": 0.67,
}
# End of fixed values.

# Grams of a piece.
PIECES = {
    "egg": 50, "eggs": 50, "clove": 3, "cloves": 3, "head": 200, "bulb": 150, "bunch": 30, "sprig": 2, "sprigs": 2, "leaf": 1, "leaves": 1, "bay": 1, "handful": 80, "piece": 50, "pieces": 50,
    "carrot": 60, "carrots": 60, "onion": 150, "onions": 150, "lemon": 60, "lemons": 60, "lime": 30, "limes": 30, "rib": 10, "ribs": 10, "stalk": 10, "stalks": 10,
}
# End of fixed values.

# Names of more than one word, tried in this order.
COMPOUNDS = (
    "black pepper", "white pepper", "kosher salt", "sea salt", "table salt", "olive oil", "coconut oil", "vegetable oil", "canola oil", "sesame oil", "whole milk", "skim milk",
    "heavy cream", "sour cream", "cream cheese", "chicken stock", "beef stock", "vegetable stock", "chicken broth", "beef broth", "all-purpose flour", "bread flour",
    "whole wheat flour", "cake flour", "panko bread crumbs", "fresh bread crumbs", "dry bread crumbs", "parmesan cheese", "mozzarella cheese", "ricotta cheese", "cheddar cheese",
    "feta cheese", "parsley leaves", "sage leaves", "bay leaves", "basil leaves", "mint leaves", "soy sauce", "fish sauce", "hot sauce", "worcestershire sauce", "oyster sauce",
    "baking powder", "baking soda", "vanilla extract", "lemon juice", "lime juice", "tomato paste", "tomato sauce", "crushed tomatoes", "diced tomatoes", "cherry tomatoes",
    "green onions", "red onions", "sweet onions", "yellow onions", "bell peppers", "red peppers", "green peppers", "jalapeño peppers",
)
# End of fixed values.

# Items that a diet forbids or that mark an allergen.
GLUTEN = ("flour", "wheat", "bread", "pasta", "barley", "rye", "oats", "bulgur", "couscous", "farro", "spelt", "kamut", "semolina", "durum", "bran", "cracker", "cereal", "malt", "beer", "soy sauce", "teriyaki")
DAIRY = ("milk", "cheese", "butter", "cream", "yogurt", "sour cream", "cottage cheese", "ricotta", "mozzarella", "cheddar", "parmesan", "feta", "goat cheese", "cream cheese", "heavy cream", "half and half", "buttermilk", "whey", "casein", "lactose", "ghee")
MEAT = ("chicken", "beef", "pork", "lamb", "turkey", "duck", "goose", "veal", "bacon", "ham", "sausage", "pepperoni", "prosciutto", "salami", "ground beef", "ground turkey", "ground chicken", "steak", "roast")
SEAFOOD = ("fish", "salmon", "tuna", "cod", "halibut", "tilapia", "trout", "bass", "shrimp", "crab", "lobster", "oyster", "clam", "mussel", "scallop", "squid", "octopus", "anchovy", "sardine", "mackerel", "sea bass", "crab meat", "crab cakes", "fish sauce", "worcestershire")
SHELLFISH = ("shrimp", "crab", "lobster", "oyster", "clam", "mussel", "scallop", "crayfish", "langostino", "crab meat", "lobster meat")
EGG = ("egg", "eggs", "egg white", "egg yolk", "mayonnaise", "mayo", "meringue", "custard", "eggnog", "hollandaise", "caesar dressing")
NUT = ("almond", "walnut", "pecan", "cashew", "pistachio", "hazelnut", "brazil nut", "macadamia", "pine nut", "chestnut", "nut", "nuts", "almond flour", "almond milk", "walnut oil", "nut butter")
PEANUT = ("peanut", "peanuts", "peanut butter", "peanut oil", "groundnut")
SOY = ("soy", "soy sauce", "tofu", "tempeh", "miso", "edamame", "soybean", "soy milk", "soy protein", "tamari", "teriyaki", "hoisin")
HIGH_CARB = ("rice", "pasta", "bread", "potato", "sweet potato", "quinoa", "oats", "barley", "corn", "beans", "lentils", "chickpeas", "sugar", "honey", "maple syrup", "flour", "noodles")
SUGAR = ("sugar", "brown sugar", "honey", "maple syrup", "corn syrup", "agave", "molasses", "candy", "chocolate", "jam", "jelly", "frosting", "icing", "cake", "cookies", "pie", "dessert")
HIGH_SODIUM = ("salt", "soy sauce", "fish sauce", "worcestershire", "bacon", "ham", "sausage", "cheese", "olives", "pickles", "capers", "anchovies", "broth", "stock", "bouillon", "processed")
NOT_KOSHER = ("pork", "ham", "bacon", "sausage", "pepperoni", "lard", "shrimp", "crab", "lobster", "oyster", "clam", "mussel", "scallop", "shellfish", "rabbit", "duck", "goose")
NOT_HALAL = ("pork", "ham", "bacon", "sausage", "pepperoni", "lard", "alcohol", "wine", "beer", "rum", "vodka", "whiskey", "gelatin")
NOT_PALEO = ("grain", "rice", "wheat", "oats", "barley", "corn", "quinoa", "beans", "lentils", "chickpeas", "peanuts", "soy", "dairy", "milk", "cheese", "yogurt", "sugar", "processed")
ANIMAL = ("honey", "gelatin", "lard", "tallow", "bone", "fish sauce")
WHOLESOME = ("olive oil", "avocado", "salmon", "nuts", "seeds", "oats", "beans", "lentils", "spinach", "broccoli", "berries")
UNWHOLESOME = ("processed", "fried", "fast food", "junk")
# End of fixed values.

# Diets with the words that name them, and the words that no item may hold.
DIETS = {
    "Gluten-Free": (("gluten-free", "gluten free", "celiac", "wheat-free"), ("wheat", "barley", "rye", "spelt", "kamut", "farro", "bulgur", "semolina", "durum", "flour", "bread", "pasta", "noodles", "crackers", "cookies", "cake", "muffins", "bagels", "pizza dough", "breadcrumbs", "panko", "coating", "batter", "beer", "ale", "malt", "brewer's yeast", "soy sauce", "teriyaki sauce", "worcestershire sauce", "some seasonings", "some broths")),
    "Egg-Free": (("egg-free", "egg free", "no eggs"), ("eggs", "egg", "egg whites", "egg yolks", "whole eggs", "scrambled eggs", "fried eggs", "boiled eggs", "poached eggs", "mayonnaise", "aioli", "hollandaise", "caesar dressing", "custard", "meringue", "eggnog", "quiche", "frittata")),
    "Peanut-Free": (("peanut-free", "peanut free", "no peanuts"), ("peanuts", "peanut butter", "peanut oil", "groundnuts", "arachis oil", "mixed nuts", "trail mix")),
    "Pescatarian": (("pescatarian", "fish only", "no meat"), ("beef", "pork", "chicken", "turkey", "duck", "lamb", "veal", "bacon", "ham", "sausage", "pepperoni", "meat", "poultry")),
    "Ketogenic": (("keto", "ketogenic", "low carb", "high fat"), ("bread", "pasta", "rice", "potatoes", "sugar", "honey", "fruits", "beans", "lentils", "oats", "quinoa", "corn")),
    "Paleo": (("paleo", "paleolithic", "caveman diet"), ("grains", "legumes", "dairy", "processed foods", "sugar", "bread", "pasta", "beans", "lentils", "peanuts")),
    "Low Sodium": (("low sodium", "no salt", "heart healthy"), ("salt", "soy sauce", "fish sauce", "processed foods", "canned foods", "pickles", "olives", "bacon")),
    "Heart-Healthy": (("heart healthy", "heart-healthy", "low cholesterol"), ("saturated fat", "trans fat", "high sodium", "processed meats", "fried foods", "butter", "lard")),
}
# End of fixed values.

# Authors of sites without one.
SITE_AUTHORS = {
    "allrecipes.com": "Allrecipes Community", "foodnetwork.com": "Food Network Kitchen", "seriouseats.com": "Serious Eats Team", "bonappetit.com": "Bon Appétit", "epicurious.com": "Epicurious",
    "foodandwine.com": "Food & Wine", "delish.com": "Delish", "eatingwell.com": "EatingWell", "myrecipes.com": "MyRecipes", "cookinglight.com": "Cooking Light",
    "southernliving.com": "Southern Living", "realsimple.com": "Real Simple", "tasteofhome.com": "Taste of Home", "betterhomesandgardens.com": "Better Homes & Gardens",
    "pillsbury.com": "Pillsbury", "kraftrecipes.com": "Kraft Recipes", "campbells.com": "Campbell's Kitchen",
}
# End of fixed values.

# Grams of units in the table with items of its own, and in the simple table.
UNIT_GRAMS = {
    "cup": 240.0, "c": 240.0, "tablespoon": 15.0, "tbsp": 15.0, "tbs": 15.0, "teaspoon": 5.0, "tsp": 5.0, "ts": 5.0, "pound": 453.592, "lb": 453.592, "lbs": 453.592, "ounce": 28.3495, "oz": 28.3495,
    "gram": 1.0, "g": 1.0, "kilogram": 1000.0, "kg": 1000.0, "liter": 1000.0, "l": 1000.0, "milliliter": 1.0, "ml": 1.0, "piece": 100.0, "pcs": 100.0, "clove": 3.0, "slice": 25.0,
}
ITEM_GRAMS = {
    "flour": {"cup": 120.0, "c": 120.0}, "sugar": {"cup": 200.0, "c": 200.0}, "butter": {"cup": 227.0, "c": 227.0, "tablespoon": 14.0, "tbsp": 14.0}, "milk": {"cup": 240.0, "c": 240.0},
    "water": {"cup": 240.0, "c": 240.0}, "oil": {"cup": 218.0, "c": 218.0, "tablespoon": 13.6, "tbsp": 13.6},
}
UNKNOWN_GRAMS = 100.0
SIMPLE_GRAMS = {
    "g": 1.0, "gram": 1.0, "grams": 1.0, "kg": 1000.0, "kilogram": 1000.0, "kilograms": 1000.0, "oz": 28.35, "ounce": 28.35, "ounces": 28.35, "lb": 453.59, "pound": 453.59, "pounds": 453.59,
    "cup": 240.0, "cups": 240.0, "tbsp": 15.0, "tablespoon": 15.0, "tablespoons": 15.0, "tsp": 5.0, "teaspoon": 5.0, "teaspoons": 5.0, "ml": 1.0, "milliliter": 1.0, "milliliters": 1.0,
    "l": 1000.0, "liter": 1000.0, "liters": 1000.0, "handful": 80.0, "handfuls": 80.0, "pinch": 1.0, "pinches": 1.0, "dash": 1.0, "dashes": 1.0, "leaves": 1.0, "leaf": 1.0, "clove": 3.0,
    "cloves": 3.0, "piece": 50.0, "pieces": 50.0,
}
# End of fixed values.
