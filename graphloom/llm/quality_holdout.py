"""Hand-checked texts of all four kinds, used only to calibrate the quality model."""

# Fixed values: (kind, text), written and checked by hand.
HOLDOUT: list[tuple[str, str]] = [
    ("prose", "The ferry left an hour late because nobody had found the key to the engine room. We waited on the quay and drank cold tea."),
    ("prose", "when the rain stopped the children ran back to the field and played until it was too dark to see the ball"),
    ("prose", "WE HAVE CLOSED THE OFFICE FOR THE WEEK. PLEASE CALL AGAIN ON MONDAY IF THE MATTER IS URGENT."),
    ("prose", "Die Brücke wurde im letzten Jahr gesperrt, weil ein Pfeiler nachgegeben hatte. Seitdem fahren alle über den alten Damm."),
    ("prose", "Le boulanger ouvre à six heures, mais il n'y a plus de pain après neuf heures. Les voisins le savent et se lèvent tôt."),
    ("prose", "La biblioteca cerró antes de lo previsto porque se fue la luz. Los lectores salieron despacio y esperaron en la plaza."),
    ("prose", "# Notes on the garden\n\nThe roses did not survive the frost, although we had covered them twice. Next year we shall plant them closer to the wall."),
    ("prose", "To repair the pump you need three things before you start, and none of them is expensive.\n\n- a spanner\n- a seal\n- some grease\n\nClose the valve first and wait until the pressure has fallen. Then open the lid slowly, because there may still be water inside."),
    ("prose", "Anna: Did you see what happened at the station this morning?\nPaul: No, I took the bus because the train was cancelled again.\nAnna: There was a goat on the platform and nobody knew what to do about it."),
    ("prose", "The committee met on\nThursday and could not\nagree on the date of the\nnext election, so the\nchair asked everyone to\nwrite down a proposal and\nsend it in before Friday."),
    ("prose", "He weighed 82 kg in May, 79 kg in June and 81 kg in July, which was a little more than the doctor had hoped for."),
    ("prose", "Is this the house? It is. Then why is the door open?"),
    ("prose", "The results of the second run are shown below, and they agree with the first run except in one place.\n\nrun | time\none | 12.1\ntwo | 12.4\n\nThe difference is small enough to be ignored, although it would be wise to repeat the test on another machine before the end of the year."),
    ("prose", "Der Zug hatte Verspätung und wir kamen\nerst nach Mitternacht an, aber der Wirt\nhatte auf uns gewartet und eine Suppe\nwarm gehalten."),
    ("prose", "elle a fermé la fenêtre parce que le vent faisait tomber les papiers et elle est retournée à son bureau sans dire un mot"),
    ("prose", "el perro no quiso entrar en la casa aunque hacía mucho frío y los niños lo llamaron desde la puerta"),
    ("list", "- apples\n- brown sugar\n- two lemons\n- flour\n- butter\n- cinnamon sticks"),
    ("list", "1. call the bank\n2. book the hall\n3. print tickets\n4. buy candles\n5. invite neighbours"),
    ("list", "Things to pack\nsleeping bag\nhead torch\ngas stove\nmatches\nrain jacket\nspare socks\nmap of the valley"),
    ("list", "Berlin / Madrid / Oslo / Lisbon / Vienna / Prague / Old Town Hall / Warsaw / Rome / Athens"),
    ("list", "salt, black pepper, garlic, two onions, olive oil, thyme, bay leaf, white wine, chicken stock, parsley"),
    ("list", "[x] clean the filter\n[x] oil the hinge\n[ ] replace lamp\n[ ] order new rope\n[ ] paint the gate"),
    ("list", "* Tiere\n    * Hund\n    * graue Katze\n* Pflanzen\n    * Rose\n    * alter Ahorn\n* Steine"),
    ("list", "a) stylo bleu\nb) cahier\nc) règle\nd) gomme\ne) trousse rouge"),
    ("list", "red kite; barn owl; grey heron; common swift; house martin; little egret; green woodpecker"),
    ("list", "Here is what we still have to do before the move.\n• cancel the newspaper\n• kitchen boxes\n• return library books\n• two lamps\n• carpet in the hall\n• spare keys"),
    ("list", "– hammer\n– long nails\n– sandpaper\n– wood glue\n– saw"),
    ("list", "mesa\nsilla vieja\nlámpara\nalfombra\narmario grande\nespejo\ncuadro"),
    ("table", "| name | age | town |\n|---|---|---|\n| Ada | 36 | Oslo |\n| Bob | 41 | Bergen |\n| Cal | 29 | Moss |"),
    ("table", "name,age,town\nAda,36,Oslo\nBob,41,Bergen\nCal,29,Moss\nDot,,Oslo"),
    ("table", "item\tprice\tstock\nlamp\t12.50\t4\nchair\t39.00\t11\ndesk\t120.00\t2"),
    ("table", "city      people   area\nOslo      700000   454\nBergen    285000   465\nTromso    77000    2521"),
    ("table", "date ; depth ; colour\n2020-01-04 ; 4.2 ; green\n2020-01-05 ; 4.4 ; brown\n2020-01-06 ; n/a ; green"),
    ("table", "+------+-----+\n| name | age |\n+------+-----+\n| Ada  | 36  |\n| Bob  | 41  |\n+------+-----+"),
    ("table", "Measured depths of the last week are in the rows that follow.\nstation,mon,tue,wed\nnorth pier,2.1,2.2,2.0\nold mill,0.9,1.1,1.0\nweir,3.4,3.1,3.3\nlock,2.0,2.0,2.1"),
    ("table", "Ort\tJahr\tZahl\nKiel\t1999\t12\nBonn\t2001\t7\nUlm\t2003\t-"),
    ("table", "key;value\nalpha;1\nbeta;2\ngamma;3\ndelta;4"),
    ("table", "train   from           to             minutes\nRE 5    Hauptbahnhof   Hafen          12\nRB 14   Marktplatz     Universität    31\nS 2     Flughafen      Altstadt Nord  27"),
    ("junk", "U2FsdGVkX1+vupppZksvRf5pq5g5XjFRlipRkwB0K1Y96Qsv2Lm+31cmzaAILwyt\nq83nf0s+Jx2mPz8Qw1ErTyUiOpAsDfGhJkLzXcVbNm0987654321QWErtyUIOPas"),
    ("junk", "0000  de ad be ef 00 11 22 33 44 55 66 77 88 99 aa bb\n0010  cc dd ee ff 12 34 56 78 9a bc de f0 01 02 03 04"),
    ("junk", "========================\n------------------------\n************************ 4\n~~~~~~~~~~~~~~~~~~~~~~~~"),
    ("junk", "spam spam spam spam spam spam SPAM spam spam spam spam spam spam spam spam spam spam spam"),
    ("junk", "buy now! buy now! buy now! buy now! buy now! buy now! buy now! buy now! buy now! buy now!"),
    ("junk", "xkq vbnzt wrrpl qqzs mmtkjd hgfw plkjz rtvbx wqzzk dfghjk ljhg trpq zxv bnmk lpq wrtz kjh"),
    ("junk", "Ã¤Â¶ â‚¬Å¾ ÐŸÑ€Ð¸ Ã¼ÃŸ â€œÂ» Ã©Â¨ Â±Â¤ Ð²ÐµÑ‚ Ã¶Ã¤ â€šÂ¬ Å“Â¶ Â¼Â½ Ã±Â¿"),
    ("junk", "4f9a77c1e0b2d35568aa90ffed1203bc77a6e5d4c3b2a190817263544f5e6d7c8b9a0f1e2d3c4b5a69788796a5b4c3d2"),
    ("junk", "#### ##### ### ######\n....  ..... ....\n%%%% %%% %%%%%%\n++++ ---- ++++"),
    ("junk", "old gate ... old gate ... old gate ... old gate ... old gate ... old gate ... old gate ..."),
]
