"""Sequences of the golden tests. Counts that the tests expect belong to these letters."""

LEFT = (
    "CATCGATGCGAGACGCCTGTCGCGGGGAATTGTGGGGCGGACCACGCTCTGGCTAACGAGCTACCGTTTCCTTTAACCTGCCAGACGGTGACCAGGGCCGTTCGGCGTTG"
    "CATCGAGCGGTGTCGCTAGCGCAATGCGCAAGATTTTGACATTTACAAGGCAACATTGCAGCGTCCGATGGTCCGGTGGCCTCCAGATAGTGTCCAGTCGCTCTAACTGT"
    "ATGGAGACCATAGGCATTTACCTTATTCTCATCGCCACGCCCCAAGATCTTTAGGACCCAGCATTCCTTTAACCACTAACATAACGCGTGTCATCTAGTTCAACAACC"
)
RIGHT = (
    "TGTCATCTAGTTCAACAACCGTTATGCCGTCCGACTCTTGCGCTCGGATGTCCGCAATGGGTTATCCCTATGTTCCGGTAATCTCTCATCTACTAAGCGCCCTAAAGGTC"
    "GTATGGTTGGAGGGCGGTTACACACCCTTAAGTACCGAACGATAGAGCACCCGTCTAGGAGGGCGTGCAGGGTCTCCCGCTAGCTAATGGTCACGGCCTCTCTGGGAAAG"
    "CTGAACAACGGATGATACCCATACTGCCACTCCAGTACCTGGGCCGCGTGTTGTACGCTGTGTATCTTGAGAGCGTTTCCAGCAGATAGAACAGGATCACATGTACATG"
)
RIGHT_OF_BUBBLE = (
    "CGACTCTTGCGCTCGGATGTCCGCAATGGGTTATCCCTATGTTCCGGTAATCTCTCATCTACTAAGCGCCCTAAAGGTCGTATGGTTGGAGGGCGGTTACACACCCTTAA"
    "GTACCGAACGATAGAGCACCCGTCTAGGAGGGCGTGCAGGGTCTCCCGCTAGCTAATGGTCACGGCCTCTCTGGGAAAGCTGAACAACGGATGATACCCATACTGCCACT"
    "CCAGTACCTGGGCCGCGTGTTGTACGCTGTGTATCTTGAGAGCGTTTCCAGCAGATAGAACAGGATCACATGTACAAA"
)
OTHER = (
    "GGTGAACAGCACATCTTTTCGTCCTGAGGCCATATTAATTCTACTCAGATTGTCTGTAACCGGAGCTTCGGGCGTATTTTTGCGTAAGACACTGCCTAAAGGGAACATAT"
    "GTGTCCAGAATAGGGTTCAACGGTGTATGAGCAAACTAGTTCAACAACCAAAAAAATTGTGTGCAAGCTACTTCTAGACCTTATTAAGTGCCCAGGAATTCCTAGGAAGG"
    "CGCGCAGCTCAAGCAATCATACATGGCGGAATGCCTGTCCACCGGGGGTTCTACTGTACCACAGTGGCCTGGATAGCTAAGCAGGTCCTGGATTGGCATGTCATCCGGAG"
    "TGATAGGCACTGCTCACGACCAGCTTGCGGACAAACGGGGTGCCCGCGCCTGCGTCCGGTAGACGAGCGATGGATTTAGACCGTTCACTGAACCCTCTAATAGGACCTCT"
    "TGCCCATCCGAGGCTTAAGC"
)
TIP = "TGTCATCTAGTTCAACAACCAAAAAAA"
BUBBLE_STRONG = "TGTCATCTAGTTCAACAACCAAAATAACGACTCTTGCGCTCGGATGT"
BUBBLE_WEAK = "TGTCATCTAGTTCAACAACCAAAAAAACGACTCTTGCGCTCGGATGT"
KILOBASE_1 = (
    "CGCTACAGCAGCTAGTTCATCATTGTTTATCAATGATAAAATATAATAAGCTAAAAGGAAACTATAAATAACCATGTATAATTATAAGTAGGTACCTATTTTTTTATTTT"
    "AAACTGAAATTCAATATTATATAGGCAAAGACTTAGATGTAAGATTTCGAAGACTTGGATGTAAACAACAAATAAGATAATAACCATAAAAATAGAAATGAACGATATTA"
    "AAATTAAAAAATACGAAAAAACTAACACGTATTGTGTCCAATAAATTCGATTTGATAATTAGGTAACAATTTAACGTTAAAACCTATTCTTTTATTATCCGAAAATCCGT"
    "CGTGGAATTTGTATTAGCTTTTTTTCTACATTACCCGTTTGCGAGACAGGTGGGGTCAGACGTAGACGTAGTCTCTGGAGTCAAGACGAAATTTTACATTTCACAATTTC"
    "CTATAGGCCGAGCAAAATTTATTAAGAACCCACAGGCATCATTACGTTTTCTTGCACAGAAGACTTCACGCTGAAGTCATTGGGCTATATTTCAACGAGACGTCTGTTGG"
    "TTTATAAAGGGCTATATTTATACAAGAATAGGAGTATGGCAGTATGCTAGGCTGGTATGTAGTACGTATACCTCCTAAGCCGAAAGGCAGTAAGTGACGATGTAATAGTT"
    "TTGAGGAAAATTACTTTTTCTGAATAATATTTTTATTTTTGTTTGCATTTTGTTAAAATTATTTACTAAATTAATGATTCTCATATGTTTTTTCATAGATTTGATGAACT"
    "ACTGTACCATCTGATTAGCGCATGGTCATAGCTGTTTCCTGTGTGAAATTGTTATCCGCTCACAATTCCACACAACATACGAGCCGGAGCATAAAGTGTAAAGCCTGGGG"
    "TGCCTAATGAGTGAGCTACTCACATAATTGCGTGCGCTCACTGCCCGCTTTCCAGTCGGAAACCTGTCGTGCCAGCTGCATTATTGATCCGCCACGCCCCGGGGAAAGT"
)
KILOBASE_2 = (
    "GTCTTCATTCAGCTGTTCTCATGATAACTAGTAATTCCTTGCTAACAATTTTTACTGAGTAGCAACCAATTAATGTTGCCAGAATTTCATAATTGAATTTGAATTTTTTA"
    "TTTTTTCCTTGATTATGCTTCAAACTCTATGTAGTTATTTAGAGTCAATAATATTAAAGCAATCTTAATATTAACTCATTTATTTCTGATTGGCCATATTTATTTAATTC"
    "TCAACAATAATAATGATAAGTATAATAATATATTTAACTTAATAACATTTTAATCATTTTATTTTTGTTTGTTGTGATTTTTGGACGTTGTGGTAAATAAGAAGTTTTAA"
    "GCTTATATTAATATGTTTTACTTTTTATTTCTTAATACGAATTTAATTACCTACCCATTATATTAAGTATATGTTTTGGAATTCTTTCTGTAAAAATGTGTTTTAAATAT"
    "TTTACACTTAATTATGTAGGTACCTATACATTTTTAAACTTATCGTATAATTCTTTTAATGGTTAAATCATACAAATTAATGTGTAGAGAATAGTTTTTATAAGACTCGT"
    "TGTCAATACGTACGCATAATATAAAAAAACTGACATGTTTTAGTAAGTCGTTTTGATGCATAATAGGATTTTTACCTTTTAAAGTCTCAAGTTTTCATACAGTGGTACCT"
    "CTATATAGAACACGTTAGGCTTTACGGGGTCATTATTTCTGTTCCGATATTTTTAATGGCATAAAACTATAAACAATAACCGGTATGTATAAATGGTAC"
)
KILOBASE_3 = (
    "ACCTGAAGCAGTAGTTCATCATATTGCGACTGCAGAATCGATGATAAAGTGGCTTTTAGATCTAAAAGCCAATACAAAACTGAAGGAATTTGATTTGATGGATTTTAATT"
    "TTGAAAATGGATTATGATTGTCGATTGATTAACAAGTTTACTAGGTTTGAATAGAGGTGATTCTTAATATTTCAAATATTTGAATGTCATGATGAATATTATAATTTATA"
    "ATTAAAAAATATCATATTTTATTCATGGATATCAAAGCTGAAAAAATAGATATTCAAAATCGCCTTTATAATAACCTATCATAAACTAATTAATCAATTAAATTCAGTTT"
    "TAAAAATTTAAATCCGACAAATAAAATTCCTTCAGCTCTGTCTGGGATTTTGGTCGAAAAATTTTAAATCGAAAAAAGTTTATCTTATTCATAATATCATTGCCAATGAT"
    "ATTAAAATTAATTAACAACGAATACAAATAACGTCCGACCTGTATATTGCGGGCCAACTGTTTTTATAGGAAATGTTGACCGAAAACTATTACAGATTAGATGTGTGTGT"
    "GTTTACCCTGTACAAAAATACAAGTACTATTACAACACATCATTATGTTAAATTGCCTCTATATTAATTTCTTTAAAACACGACCAACTGCACATTAAAGTAGTTTATTT"
    "AGTACTACAGTAGATTAAATTCATTTTTGACGAAAAATTGCATTTGAAAATGGCCATTGTGTGTATAAATATTGTATACTAATATAACTCTAAATAAAGGTTTCCAGTAC"
    "CAAAGAACCAAATTTTTAATTACAACCAAAATAACTAAATCGTATTCTTTGTTAAATAGTTAAGTTTTTCGCCGATTGCTGTGCTTGACAGTCTCCTCAATTCAGAATTT"
    "CATGTAAAATAAAAATAGCGTACATATAATGGATTGCTGTGGCATTTGGTTTGATTAATCCCAAATATTGATTCCAAATATCTATTAGCCTATTGTACCCCGGAGTACCG"
)
