"""Word lists that decide results. They must match those of the queries that users run today."""

#: Words that a title's keywords leave out.
TITLE_STOPWORDS = (
    "a an the and or of with without for in on to from by my our your best easy quick simple perfect ultimate homemade classic favorite favourite style "
    "recipe recipes make made super real authentic"
).split()
#: Words that don't count as content when a query is compared with a text.
CONTENT_STOPWORDS = (
    "a about above after again all an and any are as at be because been before being below between both but by can could did do does doing down during each "
    "easy few for from further had has have having how i if in into is it its just like make me more most my no nor not of off on once only or other our out "
    "over own quick recipe recipes same should so some such than that the their them then there these they this those through to too under until up very was "
    "we were what when where which while who whom why will with would you your"
).split()
#: Words of measure that begin an ingredient.
UNIT_WORDS = (
    "tablespoon tablespoons tbsp tbs teaspoon teaspoons tsp cup cups ounce ounces oz pound pounds lb lbs gram grams kilogram kilograms milliliter milliliters "
    "millilitre millilitres liter liters litre litres pint pints quart quarts gallon gallons clove cloves can cans package packages packet packets pkg "
    "container containers jar jars bottle bottles bunch bunches slice slices piece pieces pinch pinches dash dashes sprig sprigs stalk stalks head heads "
    "sheet sheets stick sticks envelope envelopes box boxes bag bags inch inches cm tin tins recipe batch serving servings portion g kg mg ml l cl dl fl"
).split()
#: Words of size and preparation that begin or end an ingredient.
PREP_WORDS = (
    "large medium small whole fresh freshly dried dry frozen chopped minced sliced diced grated shredded ground melted softened packed peeled cooked uncooked "
    "beaten crushed cubed halved quartered drained rinsed optional plus more about approximately finely thinly coarsely roughly lightly well very extra and or "
    "of to taste a an the such as needed each warm cold hot room temperature all-purpose allpurpose boneless skinless unsalted salted low-fat nonfat "
    "reduced-fat prepared divided firmly heaping level ripe raw toasted roasted canned bottled instant new old good quality any your favorite favourite"
).split()
#: Words of which an ingredient says little.
STAPLE_WORDS = "salt pepper water sugar butter oil flour egg milk vanilla extract garlic onion black white brown olive vegetable baking powder soda and or".split()
#: Other names of ingredients, word for word.
SYNONYMS = {
    "cilantro": "coriander", "eggplant": "aubergine", "eggplants": "aubergines", "zucchini": "courgette", "zucchinis": "courgettes", "arugula": "rocket", "beets": "beetroot",
    "beet": "beetroot", "romaine": "cos", "rutabaga": "swede", "endive": "chicory", "snow": "mangetout", "fava": "broad", "navy": "haricot", "scallions": "spring onions",
    "scallion": "spring onion", "chickpeas": "garbanzo beans", "chickpea": "garbanzo bean", "garbanzo": "chickpea", "shrimp": "prawns", "shrimps": "prawns",
    "hamburger": "minced beef", "ground": "minced", "heavy": "double", "half-and-half": "single cream", "skim": "skimmed", "cornstarch": "cornflour", "cornmeal": "polenta",
    "molasses": "treacle", "raisins": "sultanas", "raisin": "sultana", "peanuts": "groundnuts", "oatmeal": "porridge", "canola": "rapeseed", "confectioners": "icing",
    "confectioners'": "icing", "powdered": "icing", "all-purpose": "plain", "wheat": "wholemeal", "semisweet": "plain", "broth": "stock", "bouillon": "stock", "paste": "puree",
    "catsup": "ketchup", "ketchup": "tomato ketchup", "jello": "jelly", "jelly": "jam", "graham": "digestive", "cracker": "biscuit", "crackers": "biscuits", "cookies": "biscuits",
    "cookie": "biscuit", "biscuit": "scone", "candy": "sweets", "popsicle": "ice lolly", "cupcake": "fairy cake",
}
