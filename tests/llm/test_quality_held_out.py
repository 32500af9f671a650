"""Texts written by hand that no rule was made from; what comes out for all of them is in the README."""

from threshfold.llm import quality as Q

COMMON = "the of and to in a is that it for on with as at by this from or an be are was but not have which they you we he she his her their will would there what so if about who get can all one out up".split()
HELD_OUT = {
    "prose": [
        "My grandmother kept bees behind the barn until the winter of 1974, when the road was widened and the hives had to go.",
        "Rozmawiałem wczoraj z kolegą z pracy i powiedział mi, że zarząd chce sprzedać całą spółkę jeszcze w tym roku.",
        "Včera jsem mluvil se sousedem a ten mi řekl, že banka zvýšila úroky a že to nikdo nečekal.",
        "Jučer sam razgovarao sa susjedom koji kaže da će tvrtka otpustiti polovicu radnika prije ljeta.",
        "Mae'r cwmni wedi penderfynu cau'r ffatri ar ddiwedd y mis, ac mae'r gweithwyr yn poeni am eu dyfodol.",
        "Eilen illalla kävelin rannalla ja mietin, kannattaako osakkeita enää ostaa, kun korot nousevat.",
        "Tegnap este a barátommal arról beszélgettünk, hogy az árak az egekbe szöktek, és senki sem tudja, meddig tart ez.",
        "Dün akşam komşumla konuştum, şirketin borçlarını ödeyemediğini ve fabrikanın kapanacağını söyledi.",
        "Вчера вечером мы долго спорили о том, стоит ли держать деньги в банке или лучше купить золото.",
        "Χθες το βράδυ μιλούσαμε για το αν αξίζει να αγοράσει κανείς σπίτι τώρα που ανέβηκαν τα επιτόκια.",
        "IT WAS THE WORST QUARTER I HAVE SEEN IN TWENTY YEARS AND NOBODY ON THE CALL ASKED A SINGLE QUESTION ABOUT IT",
        "so i finally sold everything and paid off the car, feels strange but also kind of good, ask me again in a year lol",
        "Three things happened. First, the bank called. Second, my brother moved out; third, I stopped checking the price every hour.",
        "The recipe is simple: flour, butter, sugar, two eggs, a pinch of salt, and more patience than most people have on a Sunday.",
        "He said \"no\".\nShe said \"maybe\".\nThey argued about it for an hour\nand then went home without deciding.",
        "Dear all,\n\nthe meeting is moved to Thursday because the room is being painted. Please bring the printed figures.\n\nBest,\nthe office",
        "Ik heb gisteren mijn aandelen verkocht omdat ik het gevoel had dat de markt te duur werd, maar ik kan het mis hebben.",
        "Jag pratade med min bror igår och han tror att priserna kommer att sjunka till hösten.",
    ],
    "list": [
        "- milk\n- eggs\n- two lemons\n- olive oil\n- bread",
        "1) passport\n2) charger\n3) sun cream\n4) tickets",
        "Lisbon\nPorto\nMadrid\nSeville\nGranada\nValencia",
        "* oak\n* ash\n* elm\n* rowan\n* hornbeam",
        "red, green, blue, yellow, violet, orange, brown, black, white",
        "https://a.example/1\nhttps://a.example/2\nhttps://a.example/3\nhttps://a.example/4\nhttps://a.example/5",
        "AAA; BBB; CCC; DDD; EEE; FFF; GGG",
        "• Annual report\n• Balance sheet\n• Cash flow\n• Footnotes",
    ],
    "table": [
        "name\tcity\tage\nAnn\tLeeds\t41\nBob\tYork\t39\nCy\tHull\t27",
        "| fruit | colour | taste |\n|---|---|---|\n| apple | red | sweet |\n| lemon | yellow | sour |\n| plum | blue | mild |",
        "day,high,low,rain\nMon,12,4,0.2\nTue,14,6,0.0\nWed,11,5,3.1",
        "Team       Won   Lost\nRovers     12    3\nUnited     9     6\nAthletic   4     11",
        "fruit\tcolour\ttaste\napple\tred\tsweet\nlemon\tyellow\tsour\nplum\tblue\tmild",
        "Country    Capital    Currency\nNorway     Oslo       krone\nPoland     Warsaw     zloty\nJapan      Tokyo      yen",
        "2019;Q1;10,2;3\n2019;Q2;11,0;4\n2019;Q3;9,8;2",
    ],
    "junk": [
        "asdkjh qwpoei zmxncb lkjhgf poiuyt mnbvcx qazwsx edcrfv tgbyhn ujmikl",
        "buy buy buy buy buy buy buy buy buy buy buy buy",
        "if (x == null) { return foo[0]; }\nfor (int i = 0; i < n; i++) { bar(i); }",
        "<table><tr><td class=\"a\"></td><td class=\"b\"></td></tr></table><br/><hr/>",
        "====================\n********************\n--------------------",
        "iVBORw0KGgoAAAANSUhEUgAAAAUAAAAFCAYAAACNbyblAAAAHElEQVQI12P4z8AABQABAAD",
        "😀😀😀 🔥🔥 💯💯💯 !!! ???",
        "ÐŸÑ€Ð¸Ð²ÐµÑ‚ ÐºÐ°Ðº Ð´ÐµÐ»Ð° Ã¤Ã¶Ã¼",
        "Home | Login | Sign up | About | Contact | Privacy | Terms | Cookies",
    ],
}


def confusion():
    judge = Q.Judge(COMMON)
    return [(want, got, t) for want, texts in HELD_OUT.items() for t, got in zip(texts, judge(texts)["form"], strict=True)]


def test_held_out_forms():
    wrong = [x for x in confusion() if x[0] != x[1]]
    assert not wrong, wrong


def test_the_rule_that_gave_a_form_is_recorded():
    judge = Q.Judge(COMMON)
    names = {n for n, _, _ in Q.SEGMENT_RULES}
    for want, texts in HELD_OUT.items():
        for reasons in judge(texts)["reasons"]:
            assert (reasons[-1:] == [f"form_{want}"]) == (want != "prose")
            assert bool(names & set(reasons)) == (want != "prose")
