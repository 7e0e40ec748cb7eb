"""Texts of all four kinds, written and labelled by hand for the tests: neither trained nor calibrated on."""

HELD_OUT: list[tuple[str, str]] = [
    ("prose", "My aunt kept bees on the roof of a bank. Every spring the director asked her to move them, and every autumn he came for his jar."),
    ("prose", "nobody could say when the clock had stopped but the whole street had grown used to being ten minutes late"),
    ("prose", "THE LIFT IS OUT OF ORDER AGAIN. PLEASE USE THE STAIRS AND DO NOT LEAVE BICYCLES IN THE HALL."),
    ("prose", "Wir haben den Keller dreimal ausgepumpt, doch das Wasser kam jedes Mal zurück. Erst der neue Graben hat geholfen."),
    ("prose", "Am Abend saßen alle\num den Ofen, und der\nGroßvater erzählte von\nder Zeit, als es im Dorf\nnoch keinen Strom gab."),
    ("prose", "Quand la neige est tombée, les routes ont été fermées et nous sommes restés trois jours de plus chez eux."),
    ("prose", "le facteur ne passe plus que deux fois par semaine et personne ne s'en plaint parce que les lettres sont rares"),
    ("prose", "Mi hermano compró una barca vieja y la pintó de verde. Desde entonces pasa los domingos en el río, aunque no sabe nadar."),
    ("prose", "## What went wrong\n\nThe update was sent to every shop at once, so all of them failed at once. From now on we shall begin with one shop and wait for a day."),
    ("prose", "I bought 3 tins of paint for 24.50 each, 2 brushes and 1 roll of tape, and I still had to go back because the blue was too dark."),
    ("prose", "Did it work? Not at first. Then someone found the switch."),
    ("prose", "The choir meets on Tuesdays in the old school, and new voices are always welcome.\n\n- bring a pencil\n- bring water\n\nThere is no audition, but we do ask that you come at least twice a month, since the pieces are long and need time."),
    ("prose", "She wrote that the figures below had been copied by hand, which explains why one of them is plainly wrong.\n\nyear, lambs\n1911, 42\n1912, 420\n\nThe farmer himself had a good laugh when he was told about the second one."),
    ("prose", "Tom: Where did you put the ladder after the party?\nEve: I thought that you had taken it back to the neighbour.\nTom: Then it must still be standing behind the shed in the rain."),
    ("prose", "As far as anyone remembers the well was never dry, not even in the summer when the lake could be crossed on foot and the fish had to be carried away in buckets."),
    ("prose", "> The second offer was lower than the first.\n> We did not reply to it and waited until the month was over.\n\nThat was the right decision, as it turned out when the third offer came."),
    ("list", "- bread\n- milk\n- dark chocolate\n- batteries\n- stamps"),
    ("list", "1) unplug the heater\n2) open the lid\n3) remove dust\n4) check the fuse\n5) close the lid"),
    ("list", "Birds seen on Sunday\nblackbird\ngreat tit\nwren\nrobin\nlesser spotted woodpecker\nmagpie\njay"),
    ("list", "Bern / Turin / Lyon / Ghent / Porto / Bilbao / New Quay / Graz / Bari / Cork"),
    ("list", "chalk, two rulers, blue ink, compass, glue, scissors, brown paper, string, pins, tape"),
    ("list", "[ ] water plants\n[x] feed cat\n[ ] pay rent\n[x] mend gate\n[ ] ring Paula\n[ ] buy oil"),
    ("list", "* Obst\n    * Birne\n    * reife Pflaume\n* Gemüse\n    * Lauch\n    * roter Kohl"),
    ("list", "• pain complet\n• beurre salé\n• six oeufs\n• lait\n• farine\n• sucre roux"),
    ("list", "oak; silver birch; hazel; field maple; rowan; common alder; wild cherry; goat willow"),
    ("list", "camisa\npantalón negro\ncalcetines\ncinturón\nabrigo largo\ngorro\nguantes"),
    ("list", "These are the spare parts we ordered last week.\n– drive belt\n– four bolts\n– rubber ring\n– fan\n– glass lid\n– hose"),
    ("list", "a. first floor\nb. cellar\nc. attic\nd. north stairs\ne. yard\nf. bicycle shed"),
    ("table", "| part | length | weight |\n|---|---|---|\n| beam | 240 | 18 |\n| post | 210 | 15 |\n| rail | 120 | 6 |"),
    ("table", "town,county,people\nAlby,North,1200\nBrook,,310\nCasey,West,9800\nDunn,East,45"),
    ("table", "code\tname\tqty\n11\tnut\t400\n12\tbolt\t390\n13\twasher\t1200"),
    ("table", "river     length   mouth\nAare      288      Rhine\nDrau      749      Danube\nNeckar    367      Rhine"),
    ("table", "time ; wind ; cloud\n06:00 ; 12 ; 8\n09:00 ; 15 ; 7\n12:00 ; 21 ; 3\n15:00 ; 18 ; 4"),
    ("table", "+-----+------+\n| day | rain |\n+-----+------+\n| mon | 2.1  |\n| tue | 0.0  |\n+-----+------+"),
    ("table", "The takings of each stall follow here.\nstall,sat,sun\nhoney,210,188\ncheese,340,402\nsoap,95,120\nhats,60,75"),
    ("table", "Linie   Start         Ziel        Minuten\n4       Nordbad       Zoo         18\n7       Altmarkt      Werft       26\n12      Messe West    Stadion     9"),
    ("table", "id;state;owner\n1;open;kim\n2;closed;lee\n3;open;\n4;open;ana"),
    ("junk", "TWFueSBoYW5kcyBtYWtlIGxpZ2h0IHdvcmsuTWFueSBoYW5kcyBtYWtlIGxpZ2h0\nIHdvcmsuTWFueSBoYW5kcyBtYWtlIGxpZ2h0IHdvcmsuTWFueSBoYW5kcyBtYWtl"),
    ("junk", "00000000  7f 45 4c 46 02 01 01 00 00 00 00 00 00 00 00 00\n00000010  03 00 3e 00 01 00 00 00 40 10 00 00 00 00 00 00"),
    ("junk", "++++++++++++++++++++\n____________________\n~~~~~~~~~~~~~~~~~~~~ 7\n===================="),
    ("junk", "free free free free free FREE free free free free free free free free free free free free free free"),
    ("junk", "click here! click here! click here! click here! click here! click here! click here! click here! click here! click here! click here!"),
    ("junk", "grtk plwqz xnvb dfkj qwrt zzpl mnbv ckjh tgbr wsxz plmk njhb vgtf crdx zsaw qplm wnkb htvr cfgd xszw prtl"),
    ("junk", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855a1b2c3d4e5f60718293a4b5c6d7e8f90"),
    ("junk", "Ã¶ÃŸ Â¤Â¶ Ð¾Ñ‚ â€ž Å¸Â¼ Ã¦Â± Â½Ã± Ð½Ð° â€¡ Ã®Â¿ Â¾Å¾ Ã»Â¬ Â¶Ã¨ Ð¿Ñ€ Â¼Ã¥"),
    ("junk", "next page ... next page ... next page ... next page ... next page ... next page ... next page ... next page ..."),
]
