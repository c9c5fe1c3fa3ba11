SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
