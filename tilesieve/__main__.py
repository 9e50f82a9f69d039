from tilesieve.cli import main

raise SystemExit(main())
